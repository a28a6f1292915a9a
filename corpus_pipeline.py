"""The corpus pipeline: documents that stay after each stage, written and read again before the next.

Every stage takes (spark, docs, sf_dir).  All but the last return the columns of
documents; n_chars follows the text, and further columns of docs, whatever their names,
are left out.  What stages make of odd rows:

- A null text, an empty one and one without a letter are rejected by the first stage.  Later
  stages keep them: they have no lines, no set, no hits, and length 0.
- A null doc_id is the last in order, a null lang or source changes nothing.
- Of repeated rows and equal texts the first (line_dedup: by doc_id, then place; near_duplicates: by
  place in the input) stays; the other stages judge each row by itself.
- An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lodestream.llm import decontamination, jaccard_join, language_id, line_dedup, packing
from lodestream.llm.folds import fold
from lodestream.llm.storage import table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Five words and a similarity of 0.8.
NEAR_K, NEAR_PERCENT = 5, 80


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest-centroid classifier doesn't reject."""
    model = language_id.fit(docs.filter(fold("doc_id", 3) != 1))
    return language_id.predict(docs, model, COLUMNS).filter(~F.col("rejected")).select(*COLUMNS)


def fresh_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeats of earlier runs of lines and of earlier long lines; a document of nothing else goes."""
    out = line_dedup.remove_repeated_lines(spark, docs, COLUMNS, lone=line_dedup.LONE_WORDS).filter("n_lines = 0 or n_removed < n_lines")
    return out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the first in the input, of each group of near duplicates."""
    return jaccard_join.similar_components(spark, docs, COLUMNS, k=NEAR_K, percent=NEAR_PERCENT).filter("uid = component_uid").select(*COLUMNS)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontamination.scan(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), COLUMNS).filter("n_hit = 0").select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, bucket, padded_length, batch, slot of the documents that are left."""
    return packing.pack(docs, ["doc_id"])


STAGES = [
    ("language_id", known_language),
    ("line_dedup", fresh_lines),
    ("near_duplicates", distinct_texts),
    ("decontamination", uncontaminated),
    ("packing", packed),
]
#: The first stage's classifier and the last one's programme are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = table(docs)
    return docs
