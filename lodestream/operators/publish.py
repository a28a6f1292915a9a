"""Publication: manifests, pointers, read model, bundles, lane health."""

from __future__ import annotations

import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import scoring as S
from ..sources.scratch import parts

#: Characters of a bundle that are packed at once.
PIECE = 1 << 20

TRANSITIONS = [("draft", "validated"), ("validated", "published"), ("published", "retracted"), ("validated", "quarantined"), ("quarantined", "validated")]


def active_pointers(activations: DataFrame, at: Column) -> DataFrame:
    """The latest manifest that each lane had activated by ``at``."""
    return activations.filter(F.col("activated_at") <= at).groupBy("lane").agg(F.max_by("manifest_id", F.struct("activated_at", "manifest_id")).alias("manifest_id"))


def latest_objects(objects: DataFrame, pointers: DataFrame, logical: str = "logical_id") -> DataFrame:
    """Newest version of each logical object within the active manifests; filters come after this."""
    rows = objects.join(pointers, ["lane", "manifest_id"], "left_semi")
    key = F.coalesce(F.nullif(F.col(logical), F.lit("")), F.col("object_id").cast("string"))
    return rows.withColumn("_n", F.row_number().over(W.partitionBy("lane", key).orderBy(F.desc("created_at"), F.desc("object_id")))).filter("_n = 1").drop("_n")


def summary(objects: DataFrame, keys: list[str]) -> DataFrame:
    return objects.groupBy(*keys).agg(F.count("*").alias("objects"))


def transitioned(objects: DataFrame, target: str = "target_state") -> DataFrame:
    """Adds new_state and allowed: only listed transitions are made."""
    allowed = None
    for a, b in TRANSITIONS:
        rule = (F.col("state") == a) & (F.col(target) == b)
        allowed = rule if allowed is None else allowed | rule
    return objects.withColumn("allowed", allowed).withColumn("new_state", F.when(allowed, F.col(target)).otherwise(F.col("state")))


def bundle_lines(objects: DataFrame, order: str) -> DataFrame:
    """(lane, order, line): one JSON text an object."""
    return objects.select("lane", order, F.to_json(F.struct(*[c for c in objects.columns if c != "lane"])).alias("line"))


def bundle_checksum(lines: DataFrame, order: str) -> DataFrame:
    """(lane, checksum, lines): 'sha256:' and the SHA-256 of a lane's lines joined by line ends, as a consumer computes it from the file.

    Lines are sorted in ranges of (lane, order), each of which packs them into compressed pieces of about PIECE bytes.
    The task that hashes a lane sorts pieces by their place, a small part of the text, and holds
    one piece at a time.  (The digest of one text can't be computed in parts.)
    """

    def pack(batches):
        lane, held, size, n = None, [], 0, 0

        def done():
            nonlocal held, size, n
            row = {"lane": lane, "at": n, "n": len(held), "piece": zlib.compress("\n".join(held).encode(), 1)}
            held, size, n = [], 0, n + 1
            return pa.RecordBatch.from_pylist([row], schema=pieces)

        for b in batches:
            for key, line in zip(b.column("lane").to_pylist(), b.column("line").to_pylist(), strict=True):
                if held and (key != lane or size > PIECE):
                    yield done()
                lane, size = key, size + len(line)
                held.append(line)
        if held:
            yield done()

    def run(batches):
        lane, digest, n = None, None, 0
        for b in batches:
            for key, count, piece in zip(*(b.column(c) for c in ("lane", "n", "piece")), strict=True):
                if digest is None or key.as_py() != lane:
                    if digest is not None:
                        yield pa.RecordBatch.from_pylist([{"lane": lane, "checksum": f"sha256:{digest.hexdigest()}", "lines": n}], schema=sums)
                    lane, digest, n = key.as_py(), hashlib.sha256(), 0
                digest.update((b"\n" if n else b"") + zlib.decompress(piece.as_py()))
                n += count.as_py()
        if digest is not None:
            yield pa.RecordBatch.from_pylist([{"lane": lane, "checksum": f"sha256:{digest.hexdigest()}", "lines": n}], schema=sums)

    pieces = pa.schema([("lane", pa.string()), ("at", pa.int64()), ("n", pa.int64()), ("piece", pa.binary())])
    sums = pa.schema([("lane", pa.string()), ("checksum", pa.string()), ("lines", pa.int64())])
    ranges = lines.select("lane", order, "line").repartitionByRange(parts(lines), "lane", order).sortWithinPartitions("lane", order)
    packed = ranges.select("lane", "line").mapInArrow(pack, "lane string, at long, n long, piece binary").withColumn("range", F.spark_partition_id())
    return packed.repartition("lane").sortWithinPartitions("lane", "range", "at").select("lane", "n", "piece").mapInArrow(run, "lane string, checksum string, lines long")


def parsed_bundle(lines: DataFrame, schema: str) -> DataFrame:
    """Bundle lines (bundle, pos, line) as objects of schema; a bundle whose first line is no manifest header raises."""
    head = F.get_json_object("line", "$._type") == "manifest_header"
    fault = F.concat(F.lit("first line of bundle is no manifest header: "), F.col("bundle").cast("string"))
    good = F.when(F.coalesce(head, F.lit(False)), True).otherwise(F.raise_error(fault).cast("boolean"))
    return lines.filter((F.col("pos") > 0) | ~good).select("bundle", "pos", F.from_json("line", schema).alias("o")).select("bundle", "pos", "o.*")


def composite_bundle(objects: DataFrame, rollups: DataFrame) -> DataFrame:
    """(lane, checksum, lines) of the artifacts objects.jsonl, rollups.jsonl and manifest.json, which holds both checksums.

    objects, rollups: (object_id, line).
    """
    parts = objects.select(F.lit("objects.jsonl").alias("lane"), "object_id", "line").unionByName(rollups.select(F.lit("rollups.jsonl").alias("lane"), "object_id", "line"))
    done = bundle_checksum(parts, "object_id")
    manifest = done.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("lane", "checksum"))))).alias("line"))  # two artifacts
    root = manifest.select(F.lit("manifest.json").alias("lane"), F.concat(F.lit("sha256:"), F.sha2("line", 256)).alias("checksum"), F.lit(1).cast("long").alias("lines"))
    return done.unionByName(root)


def bundle_integrity(stored: DataFrame, lines: DataFrame, order: str) -> DataFrame:
    """(lane, intact): whether the stored checksum (lane, checksum) is that of the lines; artifacts without one on either side aren't intact."""
    again = bundle_checksum(lines, order).select("lane", F.col("checksum").alias("_again"))
    return stored.join(again, "lane", "full_outer").select("lane", F.coalesce(F.col("checksum") == F.col("_again"), F.lit(False)).alias("intact"))


def composite_id(manifests: DataFrame) -> DataFrame:
    return manifests.agg(F.concat(F.lit("composite_"), F.substring(F.sha2(F.array_join(F.array_sort(F.collect_set("manifest_id")), "\0"), 256), 1, 16)).alias("composite_id"))


def lane_health(runs: DataFrame, at: Column, fresh_hours: float, aging_hours: float, healthy: float, critical: float, sample: int) -> DataFrame:
    """Freshness, quality and readiness of each lane from its runs (completed_at, passed, total, state).

    A lane that never ran, or ran on too few objects, is unknown there, which doesn't
    block.  state: clear, watch or quarantined; the worst counts.
    """
    rank = F.when(F.col("state") == "quarantined", 2).when(F.col("state") == "watch", 1).otherwise(0)
    rows = runs.groupBy("lane").agg(F.max("completed_at").alias("last"), F.sum("passed").alias("passed"), F.sum("total").alias("total"), F.max(rank).alias("_q"))
    hours = F.greatest(F.lit(0.0), (F.unix_micros(at.cast("timestamp")) - F.unix_micros(F.col("last").cast("timestamp"))) / F.lit(3_600_000_000.0))
    fresh = F.when(F.col("last").isNull(), "unknown").when(hours <= fresh_hours, "fresh").when(hours <= aging_hours, "aging").otherwise("stale")
    rate = F.col("passed") / F.col("total")
    quality = F.when(F.col("total") < sample, "unknown").when(rate >= healthy, "healthy").when(rate >= critical, "degraded").otherwise("critical")
    state = F.when(F.col("_q") == 2, "quarantined").when(F.col("_q") == 1, "watch").otherwise("clear")
    return rows.withColumns({"freshness": fresh, "quality": quality, "state": state}).withColumn("readiness", S.readiness(F.col("freshness"), F.col("quality"), F.col("state"))).select("lane", "freshness", "quality", "state", "readiness")


def contract_supported(published: DataFrame, supported: list[str]) -> DataFrame:
    """Adds level: ok for a version in the supported set, critical for another or none."""
    return published.withColumn("level", F.when(F.coalesce(F.col("version").isin(*supported), F.lit(False)), "ok").otherwise("critical"))


def rate_check(rows: DataFrame, key: str, failed: Column, warning: float, critical: float) -> DataFrame:
    """Share of failed rows by key, and its level; a threshold itself is still the better level."""
    out = rows.groupBy(key).agg(F.avg(F.when(failed, 1.0).otherwise(0.0)).alias("rate"), F.count("*").alias("n"))
    return out.withColumn("level", S.error_level(F.col("rate"), F.lit(warning), F.lit(critical)))


def coverage_drift(counts: DataFrame, expected: DataFrame, least: int) -> DataFrame:
    """Expected lanes with their object counts, and whether they have enough."""
    return expected.join(counts, "lane", "left").select("lane", F.coalesce("objects", F.lit(0)).alias("objects"), (F.coalesce(F.col("objects"), F.lit(0)) >= least).alias("covered"))


def lane_publication(lane: str, health: DataFrame, parts: dict[str, DataFrame]) -> DataFrame:
    """(lane, object_type, object_id, payload) of all parts (object_id and more, which become the JSON payload), none where the lane is blocked.

    health: lane, readiness, one row a lane.
    """
    free = health.filter((F.col("lane") == lane) & (F.col("readiness") != "blocked")).select("lane").limit(1)
    out = None
    for kind, rows in parts.items():
        one = rows.select(F.lit(kind).alias("object_type"), F.col("object_id").cast("string").alias("object_id"), F.to_json(F.struct(*[f"`{c}`" for c in rows.columns])).alias("payload"))
        out = one if out is None else out.unionByName(one)
    return out.crossJoin(F.broadcast(free)).select("lane", "object_type", "object_id", "payload")  # one row at most
