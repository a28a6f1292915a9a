"""Names to concepts and securities, patents and research to themes, opinions and comparisons on claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import text as T

# Fixed values
ANTONYMS = {"expands_capacity": "constrains_capacity", "constrains_capacity": "expands_capacity", "launches_product": "delays_product", "delays_product": "launches_product"}
GRANT, APPLICATION, PREFERRED_SOURCE, OTHER_SOURCE, REVIEW, ALIAS_MIN, CANDIDATES = 0.95, 0.85, 0.90, 0.80, 0.75, 0.50, 10
INVESTIGATE, BLOCK = 0.05, 0.15
GENERIC = ["research", "research lab", "research labs", "laboratory", "laboratories", "advanced research", "technology", "technologies", "semiconductor", "semiconductors", "systems", "microelectronics"]
ACADEMIC, ACADEMIC_SHORT = ["university", "college", "school of", "institute of technology", "polytechnic"], ["mit", "cmu", "caltech", "ucsd", "ucla", "uiuc", "gatech", "eth", "ntu", "nus"]
ALIAS_CONFIDENCE = {"name": 0.95, "former_name": 0.82, "subsidiary": 0.86, "acquired_entity": 0.78, "lab": 0.72, "research_institution": 0.64, "abbreviation": 0.70}


def class_theme(classes: Column, themes: dict[str, str]) -> Column:
    """The theme of the first class that starts with a listed prefix; the dictionary's order decides between prefixes. None: null."""
    plain = lambda c: F.regexp_replace(F.upper(c), "[^A-Z0-9]", "")

    def theme(c):
        out = None
        for prefix, name in themes.items():
            rule = plain(c).startswith(plain(F.lit(prefix)))
            out = (F.when if out is None else out.when)(rule, name)
        return F.lit(None).cast("string") if out is None else out

    return F.try_element_at(F.filter(F.transform(classes, theme), lambda x: x.isNotNull()), F.lit(1))


def topic_theme(topics: Column, themes: dict[str, str]) -> Column:
    """The first listed theme whose words contain a topic, or are contained in one."""
    plain = lambda c: F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))

    def meets(name):
        return lambda x: plain(x).contains(plain(F.lit(name))) | plain(F.lit(name)).contains(plain(x))

    out = None
    for name, theme in themes.items():
        out = (F.when if out is None else out.when)(F.exists(topics, meets(name)), theme)
    return F.lit(None).cast("string") if out is None else out


def alias_candidates(names: DataFrame, aliases: DataFrame, limit: int = CANDIDATES) -> DataFrame:
    """(name, concept_id, confidence, review_status, place): active, not rejected concepts of each distinct name.

    names: name.  aliases: alias, concept_id, is_primary, confidence, review_status,
    is_active.  Order: primary, same case, accepted, confidence, concept.
    """
    live = aliases.filter("is_active and review_status <> 'rejected'").withColumn("_k", F.lower("alias"))
    rows = names.select("name").distinct().withColumn("_k", F.lower("name")).join(live, "_k")
    order = W.partitionBy("name").orderBy(F.desc("is_primary"), F.desc(F.col("alias") == F.col("name")), F.desc(F.col("review_status") == "accepted"), F.desc("confidence"), "concept_id")
    return rows.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit).select("name", "concept_id", "confidence", "review_status", "place")


def linked_records(records: DataFrame, names: str, aliases: DataFrame, securities: DataFrame, weight: Column, least: float = 0.0) -> DataFrame:
    """(record_id, concept_id, security_id, theme_id, confidence) of records with a theme, by each of the names in the array ``names``.

    The distinct names are resolved once, then joined back; securities: concept_id, security_id.
    """
    rows = records.filter("theme_id is not null").select("record_id", "theme_id", weight.alias("_w"), F.explode(names).alias("name"))
    found = alias_candidates(rows, aliases).filter(F.col("confidence") >= least)
    review = F.when(F.col("review_status") == "accepted", 1.0).otherwise(REVIEW)
    sure = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("confidence") * F.col("_w") * review)), 4)
    return rows.join(found, "name").join(securities, "concept_id").select("record_id", "concept_id", "security_id", "theme_id", sure.alias("confidence"))


def patent_links(patents: DataFrame, themes: dict[str, str], aliases: DataFrame, securities: DataFrame) -> DataFrame:
    """Signals of dated patents (record_id, event_date, event_type, classes, assignees)."""
    rows = patents.filter("event_date is not null").withColumn("theme_id", class_theme(F.col("classes"), themes))
    return linked_records(rows, "assignees", aliases, securities, F.when(F.col("event_type") == "grant", GRANT).otherwise(APPLICATION))


def research_links(records: DataFrame, themes: dict[str, str], aliases: DataFrame, securities: DataFrame, preferred: str = "openalex") -> DataFrame:
    """Signals of research records (record_id, source, topics, institutions); aliases below 0.5 don't count."""
    rows = records.withColumn("theme_id", topic_theme(F.col("topics"), themes))
    return linked_records(rows, "institutions", aliases, securities, F.when(F.col("source") == preferred, PREFERRED_SOURCE).otherwise(OTHER_SOURCE), ALIAS_MIN)


def resolved_identifier(securities: DataFrame, identifier: str, active_only: bool = True, limit: int = 10) -> DataFrame:
    """Securities that a ticker, CIK, name or former name means, best first; ``priority`` 0 to 6.

    securities: ticker, exchange, cik, name, issuer_name, aliases, former_names, is_active.
    """
    raw = identifier.strip()
    digits = raw.upper().removeprefix("CIK")
    cik = digits.zfill(10) if digits.isdigit() and len(digits) <= 10 else None
    low, none = F.lit(raw).substr(1, len(raw)), F.lit(False)
    has = lambda c: F.coalesce(F.exists(c, lambda x: F.lower(x) == F.lower(low)), none)
    same = lambda c: F.coalesce(F.lower(c) == F.lower(low), none)
    ticker = F.coalesce(F.col("ticker") == raw.upper(), none)
    by_cik = none if cik is None else F.coalesce(F.col("cik") == cik, none)
    hit = ticker | by_cik | same("name") | same("issuer_name") | has("aliases") | has("former_names")
    active = F.col("is_active")
    level = F.when(ticker & active, 0).when(ticker, 1).when(by_cik & active, 2).when(same("issuer_name") & active, 3).when(has("former_names") & active, 4).when(active, 5).otherwise(6)
    rows = securities.filter(hit & (active | F.lit(not active_only))) if raw else securities.limit(0)
    return rows.withColumn("priority", level).orderBy("priority", "ticker", "exchange").limit(limit)


def polarity_links(claims: DataFrame, positive: str = "positive") -> DataFrame:
    """(claim_id, link): support for the claim's own column ``positive`` if the predicate is the same, contradiction if it is the antonym; others give no row."""
    anti = F.create_map(*[F.lit(x) for pair in ANTONYMS.items() for x in pair])
    link = F.when(F.col("predicate") == F.col(positive), "support").when(F.col("predicate") == anti[F.col(positive)], "contradiction")
    return claims.select("claim_id", link.alias("link")).filter("link is not null")


def structural_summary(edges: DataFrame) -> DataFrame:
    """(predicate, current, history) and, with a null predicate, all edges; ``concepts`` counts the ends of current edges."""
    ends = edges.select("predicate", "is_current", F.explode(F.array("source", "target")).alias("_c"), F.lit(0.5).alias("_n"))
    return ends.rollup("predicate").agg(
        F.sum(F.when(F.col("is_current"), F.col("_n")).otherwise(0.0)).cast("long").alias("current"),
        F.sum(F.when(F.col("is_current"), 0.0).otherwise(F.col("_n"))).cast("long").alias("history"),
        F.countDistinct(F.when(F.col("is_current"), F.col("_c"))).alias("concepts"),
    )


def rollout_advice(compared: DataFrame, total: DataFrame) -> DataFrame:
    """One row: compared keys, material differences, their rate, and proceed, investigate or block.

    compared: severity (a row for each difference).  total: one row with the number
    of keys, ``n``; nothing compared: proceed.
    """
    counts = compared.agg(F.count("*").alias("n"), F.count_if(F.col("severity") != "minor").alias("material")).select(F.lit(1).alias("_k"), "material")
    rows = counts.join(total.select(F.lit(1).alias("_k"), "n"), "_k")  # one row each
    rate = F.when(F.col("n") > 0, F.col("material") / F.col("n")).otherwise(0.0)
    return rows.select("n", "material", rate.alias("rate"), F.when(rate >= BLOCK, "block").when(rate >= INVESTIGATE, "investigate").otherwise("proceed").alias("advice"))


def guarded_aliases(aliases: DataFrame) -> DataFrame:
    """Adds normalized, risks, confidence and review_status to aliases (alias, alias_type, and confidence or null): generic and academic names need a review and are less sure; unknown types raise."""
    name = T.innovation_alias(F.col("alias"))
    term = F.lit(False)
    for t in ACADEMIC:
        term = term | F.col("normalized").contains(t)
    academic = (F.col("alias_type") == "research_institution") | F.col("normalized").isin(*ACADEMIC_SHORT) | term
    generic = F.col("normalized").isin(*GENERIC)
    usual = F.when(F.col("alias_type").isin(*ALIAS_CONFIDENCE), T.lookup(F.col("alias_type"), ALIAS_CONFIDENCE)).otherwise(F.raise_error(F.concat(F.lit("unknown alias type: "), "alias_type")).cast("double"))
    rows = aliases.withColumn("normalized", name).withColumn("risks", F.array_compact(F.array(F.when(generic, "generic_alias"), F.when(academic, "academic_institution_collision"))))
    sure = F.coalesce("confidence", usual)
    return rows.withColumn("confidence", F.when(generic, F.least(sure, F.lit(0.35))).when(academic, F.least(sure, F.lit(0.5))).otherwise(sure)).withColumn("review_status", F.when(F.size("risks") > 0, "needs_review").otherwise("accepted"))
