"""Graph operators on edge tables: closures, shortest paths, scored paths, propagation.

Every round is a join of the frontier with the edges; visited nodes leave by an
anti join, so the frontier, not the number of paths, is what grows.  Edges and each
round's frontier are written to the shared folder, so that a round doesn't run the
rounds before it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions import scoring as S
from ..sources.scratch import discard, table

# Fixed values
RELATION_WEIGHTS = {"depends_on": 0.8, "supplies_to": 0.6, "competes_with": -0.3, "drives": 0.5, "blocks": -0.4}
GRAPH_RELATIONS = {
    "depends_on": "depends_on", "supplies_to": "supplies_to", "competes_with": "competes_with", "drives": "drives", "blocks": "blocks", "customer_of": "depends_on", "uses_technology": "depends_on", "develops_technology": "drives",
    "produces": "supplies_to", "consumes": "depends_on", "component_of": "depends_on", "contains_component": "supplies_to", "subsidiary_of": "depends_on", "parent_of": "drives", "operates_facility": "drives", "located_at": "drives",
}
HOP_DECAY, IMPACT_MIN, MAX_DEPTH, PATH_MIN = 0.7, 0.01, 3, 0.01
#: Edges of a hub that are joined at once.
PATH_CHUNK = 10_000


def reached(edges: DataFrame, seeds: DataFrame, max_depth: int) -> DataFrame:
    """(seed, node, depth): nodes reached from each seed (a column ``seed``) in 1 to max_depth steps, at their least depth."""
    edges = table(edges.select("source", "target").distinct())
    front = seeds.select("seed", F.col("seed").alias("node"))
    seen = front.withColumn("depth", F.lit(0))
    for depth in range(1, max_depth + 1):
        step = front.join(edges.withColumnRenamed("source", "node"), "node").select("seed", F.col("target").alias("node")).distinct()
        front = table(step.join(seen.select("seed", "node"), ["seed", "node"], "left_anti"))
        seen = seen.unionByName(front.withColumn("depth", F.lit(depth)))
    return seen.filter("depth > 0")


def reversed_edges(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("target").alias("source"), F.col("source").alias("target"))


def subgraph(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """Edges between nodes that lie within depth of the seed, downstream or upstream, or are the seed."""
    nodes = reached(edges, seeds, depth).select("node").union(reached(reversed_edges(edges), seeds, depth).select("node")).union(seeds.select(F.col("seed").alias("node"))).distinct()
    return edges.join(nodes.select(F.col("node").alias("source")), "source", "left_semi").join(nodes.select(F.col("node").alias("target")), "target", "left_semi").select("source", "target")


def shortest_paths(edges: DataFrame, seeds: DataFrame, max_depth: int) -> DataFrame:
    """(seed, node, depth, path): a shortest path to each node, of several the least by its nodes."""
    edges = table(edges.select("source", "target").distinct())
    front = seeds.select("seed", F.col("seed").alias("node"), F.array("seed").alias("path"))
    seen = front.withColumn("depth", F.lit(0))
    for depth in range(1, max_depth + 1):
        step = front.join(edges.withColumnRenamed("source", "node"), "node").select("seed", F.col("target").alias("node"), F.concat("path", F.array("target")).alias("path"))
        front = table(step.join(seen.select("seed", "node"), ["seed", "node"], "left_anti").groupBy("seed", "node").agg(F.min("path").alias("path")))
        seen = seen.unionByName(front.withColumn("depth", F.lit(depth)))
    return seen.filter("depth > 0")


def propagated(edges: DataFrame, seeds: DataFrame, max_depth: int = MAX_DEPTH, least: float = IMPACT_MIN) -> DataFrame:
    """(seed, node, depth, impact): level by level, impact * relation weight * confidence * 0.7.

    A node takes the first arrival: least depth, then largest size, then source and
    relation; arrivals below ``least`` don't mark it as reached.  seeds: seed, delta.
    """
    weight = F.lit(0.0)
    for k, v in RELATION_WEIGHTS.items():
        weight = F.when(F.col("relation") == k, F.lit(v)).otherwise(weight)
    out = table(edges.select(F.col("source").alias("node"), "target", "relation", (weight * F.col("confidence") * HOP_DECAY).alias("factor")))
    front = seeds.select("seed", F.col("seed").alias("node"), F.col("delta").alias("impact"))
    seen = front.withColumn("depth", F.lit(0))
    order = W.partitionBy("seed", "target").orderBy(F.desc(F.abs("next")), "node", "relation")
    for depth in range(1, max_depth + 1):
        step = front.join(out, "node").withColumn("next", F.col("impact") * F.col("factor")).filter(F.abs("next") >= least)
        step = step.withColumn("_n", F.row_number().over(order)).filter("_n = 1").select("seed", F.col("target").alias("node"), F.col("next").alias("impact"))
        front = table(step.join(seen.select("seed", "node"), ["seed", "node"], "left_anti"))
        seen = seen.unionByName(front.withColumn("depth", F.lit(depth)))
    return seen.filter("depth > 0")


def scored_paths(edges: DataFrame, least: float = PATH_MIN, chunk: int = PATH_CHUNK) -> DataFrame:
    """1- and 2-hop paths: product of edge scores (rounded to 4) times 0.7 for each further hop, sign by product.

    edges: source, target, edge_score, sign.  Of 2-hop paths middle and target differ from the source, and from each other.
    An edge that even the best one at the middle node can't lift to least is left out before the
    join.  A middle node's arrivals are dealt into parts of about ``chunk`` by source, its departures by target, and
    every part of the ones meets every part of the others in a group of its own, so a hub is no single task.
    """
    edges = table(edges.select("source", "target", "edge_score", "sign"))
    one = edges.select("source", F.lit(None).cast(edges.schema["source"].dataType).alias("middle"), "target", F.round("edge_score", 4).alias("score"), "sign", F.lit(1).alias("hops"))
    a = edges.select("source", F.col("target").alias("middle"), F.col("edge_score").alias("s1"), F.col("sign").alias("g1")).filter("source <> middle")
    b = edges.select(F.col("source").alias("middle"), "target", F.col("edge_score").alias("s2"), F.col("sign").alias("g2")).filter("target <> middle")
    parts = lambda n: F.ceil(F.col(n) / F.lit(chunk)).cast("int")
    ins = a.groupBy("middle").agg(F.count("*").alias("n"), F.max("s1").alias("best1"))
    outs = b.groupBy("middle").agg(F.count("*").alias("m"), F.max("s2").alias("best2"))
    nodes = ins.join(outs, "middle").select("middle", parts("n").alias("ins"), parts("m").alias("outs"), "best1", "best2")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    enough = F.lit(least - 0.00005)  # scores are rounded to 4
    a = a.join(nodes, "middle").filter(F.col("s1") * F.col("best2") * HOP_DECAY >= enough).select("source", "middle", "s1", "g1", F.pmod(F.xxhash64("source"), F.col("ins")).cast("int").alias("i"), every("outs").alias("j"))
    b = b.join(nodes, "middle").filter(F.col("s2") * F.col("best1") * HOP_DECAY >= enough).select("middle", "target", "s2", "g2", F.pmod(F.xxhash64("target"), F.col("outs")).cast("int").alias("j"), every("ins").alias("i"))
    two = a.join(b, ["middle", "i", "j"]).filter("target <> source").select("source", "middle", "target", F.round(F.col("s1") * F.col("s2") * HOP_DECAY, 4).alias("score"), (F.col("g1") * F.col("g2")).alias("sign"), F.lit(2).alias("hops"))
    return one.filter("source <> target").unionByName(two).filter(F.col("score") >= least)


def edge_scores(relations: DataFrame, at) -> DataFrame:
    """Adds freshness, corroboration and edge_score = confidence * freshness * corroboration, rounded to 4."""
    age = F.datediff(at, F.col("valid_from")).cast("double")
    out = relations.withColumns({"freshness": F.round(S.half_life_freshness(age), 4), "corroboration": F.round(S.corroboration_factor(F.col("support_count"), F.col("contradiction_count"), F.col("source_diversity")), 4)})
    return out.withColumn("edge_score", F.round(F.col("confidence") * F.col("freshness") * F.col("corroboration"), 4))


def baskets(paths: DataFrame) -> DataFrame:
    """Per source and target: best score and its sign, least hops, paths of each sign, role."""
    best = F.max_by(F.struct("sign"), F.struct("score", F.col("sign")))
    out = paths.groupBy("source", "target").agg(F.max("score").alias("best_score"), best["sign"].alias("sign"), F.min("hops").alias("hops"), F.count(F.when(F.col("sign") > 0, 1)).alias("positive_paths"), F.count(F.when(F.col("sign") < 0, 1)).alias("negative_paths"))
    role = F.when((F.col("positive_paths") > 0) & (F.col("negative_paths") > 0), "mixed").when(F.col("positive_paths") > 0, "beneficiary").otherwise("at_risk")
    return out.withColumn("role", role)


def adjacency(edges: DataFrame) -> DataFrame:
    """(node, targets, sources): sorted neighbours both ways."""
    down = edges.groupBy(F.col("source").alias("node")).agg(F.array_sort(F.collect_set("target")).alias("targets"))
    up = edges.groupBy(F.col("target").alias("node")).agg(F.array_sort(F.collect_set("source")).alias("sources"))
    return down.join(up, "node", "full_outer")


def refreshed_edges(supports: DataFrame) -> DataFrame:
    """Active supports folded into one edge for each (source, target, relation)."""
    return supports.filter("active").groupBy("source", "target", "relation").agg(F.max("confidence").alias("confidence"), F.array_sort(F.collect_set("origin")).alias("origins"), F.count("*").alias("supports"))


def components(edges: DataFrame) -> DataFrame:
    """(a, b): b is the least node that undirected edges (a, b: long) connect with a; nodes that are least have no row.

    Alternating large-star and small-star rounds.  Each round is joins and sums by key:
    minima are combined before the shuffle and a hub's many edges may be split by adaptive
    execution.  The number of rounds grows with the logarithm of the longest path.  Each
    round's edges are a table in the shared folder, which the next one replaces.
    """
    mark = lambda e: tuple(e.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first())
    now = table(edges.filter("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    at = mark(now)
    while at[0]:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b"))).distinct()
        last, now = now, table(small)
        discard(last)
        before, at = at, mark(now)
        if before == at:
            break
    return now


def synced_supports(assertions: DataFrame, supports: DataFrame) -> DataFrame:
    """Edge supports (source, target, relation, assertion_id, confidence) after the current assertions: strong active and disputed ones of a mapped predicate replace theirs, retracted ones lose theirs.

    assertions: assertion_id, subject, predicate, object, confidence, status.
    """
    relation = F.lit(None).cast("string")
    for k, v in GRAPH_RELATIONS.items():
        relation = F.when(F.col("predicate") == k, v).otherwise(relation)
    live = assertions.filter("object is not null and status in ('active', 'disputed') and confidence >= 0.3").withColumn("relation", relation).filter("relation is not null")
    new = live.select(F.col("subject").alias("source"), F.col("object").alias("target"), "relation", "assertion_id", "confidence")
    gone = assertions.filter("status = 'retracted'").select("assertion_id").union(new.select("assertion_id")).distinct()
    return supports.select(new.columns).join(gone, "assertion_id", "left_anti").select(new.columns).unionByName(new)


def path_explanations(paths: DataFrame) -> DataFrame:
    """(source, target, payload): JSON of scored paths (source, middle, target, score, sign, hops)."""
    return paths.select("source", "target", F.to_json(F.struct(F.col("source").alias("source_concept_id"), F.col("target").alias("target_concept_id"), "hops", F.col("score").alias("path_score"), F.col("sign").alias("path_sign"), F.col("middle").alias("intermediate_concept_id"))).alias("payload"))
