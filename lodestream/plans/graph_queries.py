"""Graph queries: supplier nations to customer nations through order lines."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from ..operators import graph as G
from .bind import table
from .registry import query

EDGES = """e AS (SELECT s.s_nationkey AS source, c.c_nationkey AS target, count(*) AS n, count(*) FILTER (l.l_returnflag = 'R') AS returned, max(l.l_shipdate) AS last_ship, count(DISTINCT s.s_suppkey) AS suppliers FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey JOIN supplier s ON l.l_suppkey = s.s_suppkey GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, target) AS k FROM e),
edges AS (SELECT source, target, ['supplies_to','depends_on','competes_with','drives','blocks'][(source + target) % 5 + 1] AS relation, 0.4 + 0.1 * ((source * 7 + target) % 6) AS confidence, CASE WHEN (source + target) % 5 IN (2, 4) THEN -1 ELSE 1 END AS sign, n, returned, suppliers, CAST(last_ship AS DATE) AS valid_from FROM r WHERE k <= 2)"""


def edges(spark, d):
    """The two strongest trade links of each supplier nation."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_returnflag", "l_shipdate").join(table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    lines = lines.join(table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey").join(table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey")
    e = lines.groupBy(F.col("s_nationkey").alias("source"), F.col("c_nationkey").alias("target")).agg(F.count("*").alias("n"), F.count(F.when(F.col("l_returnflag") == "R", 1)).alias("returned"), F.max("l_shipdate").alias("last"), F.countDistinct("l_suppkey").alias("suppliers"))
    kind = (F.col("source") + F.col("target")) % 5
    names = F.array(*[F.lit(x) for x in ("supplies_to", "depends_on", "competes_with", "drives", "blocks")])
    top = e.withColumn("k", F.row_number().over(W.partitionBy("source").orderBy(F.desc("n"), "target"))).filter("k <= 2")
    return top.select("source", "target", F.get(names, kind).alias("relation"), (0.4 + 0.1 * ((F.col("source") * 7 + F.col("target")) % 6)).alias("confidence"), F.when(kind.isin(2, 4), -1).otherwise(1).alias("sign"), "n", "returned", "suppliers", F.to_date("last").alias("valid_from"))


def _seeds(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "seed int")


_DOWN = """w AS (SELECT source AS seed, target AS node, 1 AS depth FROM edges WHERE source IN (0, 3, 11) UNION SELECT w.seed, edges.target, w.depth + 1 FROM w JOIN edges ON edges.source = w.node WHERE w.depth < 4)"""


@query(f"WITH RECURSIVE {EDGES}, {_DOWN} SELECT seed, node, min(depth) AS depth FROM w WHERE node <> seed GROUP BY 1, 2")
def graph_downstream(spark, d):
    return G.reached(edges(spark, d), _seeds(spark, 0, 3, 11), 4)


@query(f"WITH RECURSIVE {EDGES}, {_DOWN.replace('source AS seed, target AS node', 'target AS seed, source AS node').replace('WHERE source IN', 'WHERE target IN').replace('edges.target, w.depth', 'edges.source, w.depth').replace('edges.source = w.node', 'edges.target = w.node')} SELECT seed, node, min(depth) AS depth FROM w WHERE node <> seed GROUP BY 1, 2")
def graph_upstream(spark, d):
    return G.reached(G.reversed_edges(edges(spark, d)), _seeds(spark, 0, 3, 11), 4)


@query(f"""WITH RECURSIVE {EDGES}, w AS (SELECT source AS seed, target AS node, 1 AS depth, [source, target] AS path FROM edges WHERE source IN (0, 3, 11) AND target <> source UNION ALL SELECT w.seed, edges.target, w.depth + 1, list_append(w.path, edges.target) FROM w JOIN edges ON edges.source = w.node WHERE w.depth < 4 AND NOT list_contains(w.path, edges.target))
SELECT seed, node, depth, array_to_string(path, '>') AS path FROM (SELECT *, row_number() OVER (PARTITION BY seed, node ORDER BY depth, path) AS k FROM w) WHERE k = 1""")
def graph_shortest_path(spark, d):
    out = G.shortest_paths(edges(spark, d), _seeds(spark, 0, 3, 11), 4)
    return out.select("seed", "node", "depth", F.concat_ws(">", F.col("path").cast("array<string>")).alias("path"))


@query(f"""WITH RECURSIVE {EDGES}, u AS (SELECT source, target FROM edges),
dn AS (SELECT target AS node, 1 AS depth FROM u WHERE source = 3 UNION SELECT u.target, dn.depth + 1 FROM dn JOIN u ON u.source = dn.node WHERE dn.depth < 2),
up AS (SELECT source AS node, 1 AS depth FROM u WHERE target = 3 UNION SELECT u.source, up.depth + 1 FROM up JOIN u ON u.target = up.node WHERE up.depth < 2),
n AS (SELECT node FROM dn UNION SELECT node FROM up UNION SELECT 3) SELECT source, target FROM u WHERE source IN (SELECT node FROM n) AND target IN (SELECT node FROM n)""")
def graph_subgraph(spark, d):
    return G.subgraph(edges(spark, d), _seeds(spark, 3), 2)


_RW = "CASE relation WHEN 'depends_on' THEN 0.8 WHEN 'supplies_to' THEN 0.6 WHEN 'competes_with' THEN -0.3 WHEN 'drives' THEN 0.5 WHEN 'blocks' THEN -0.4 ELSE 0.0 END"


def _level(k):
    before = " UNION ALL ".join(f"SELECT seed, node FROM p{i}" for i in range(k))
    return f"""a{k} AS (SELECT p.seed, f.target AS node, p.impact * f.factor AS impact, row_number() OVER (PARTITION BY p.seed, f.target ORDER BY abs(p.impact * f.factor) DESC, p.node, f.relation) AS n FROM p{k - 1} p JOIN f ON f.source = p.node WHERE abs(p.impact * f.factor) >= 0.01),
p{k} AS (SELECT seed, node, impact FROM a{k} WHERE n = 1 AND (seed, node) NOT IN (SELECT (seed, node) FROM ({before})))"""


@query(f"""WITH {EDGES}, f AS (SELECT source, target, relation, {_RW} * confidence * 0.7 AS factor FROM edges), p0 AS (SELECT CAST(x AS INTEGER) AS seed, CAST(x AS INTEGER) AS node, 1.0::DOUBLE AS impact FROM range(25) t(x)),
{_level(1)}, {_level(2)}, {_level(3)} SELECT seed, node, 1 AS depth, round(impact, 6) AS impact FROM p1 UNION ALL SELECT seed, node, 2, round(impact, 6) FROM p2 UNION ALL SELECT seed, node, 3, round(impact, 6) FROM p3""")
def sentiment_propagation(spark, d):
    seeds = spark.range(25).select(F.col("id").cast("int").alias("seed"), F.lit(1.0).alias("delta"))
    return G.propagated(edges(spark, d), seeds).select("seed", "node", "depth", F.round("impact", 6).alias("impact"))


SCORED = f"""{EDGES}, x AS (SELECT *, round(CASE WHEN valid_from IS NULL THEN 0.5 ELSE exp(-0.6931471805599453 * greatest(date_diff('day', valid_from, DATE '2002-01-01')::DOUBLE, 0) / 90) END, 4) AS freshness, round(CASE WHEN n > 0 THEN (n - returned)::DOUBLE / n ELSE 0 END * least(1.0, suppliers / 3.0) * least(1.0, (n - returned) / 5.0), 4) AS corroboration FROM edges),
es AS (SELECT source, target, sign, round(confidence * freshness * corroboration, 4) AS edge_score FROM x),
paths AS (SELECT source, NULL::INTEGER AS middle, target, round(edge_score, 4) AS score, sign, 1 AS hops FROM es WHERE source <> target AND round(edge_score, 4) >= 0.01
 UNION ALL SELECT a.source, a.target, b.target, round(a.edge_score * b.edge_score * 0.7, 4), a.sign * b.sign, 2 FROM es a JOIN es b ON a.target = b.source WHERE a.source <> a.target AND b.target <> a.source AND b.target <> a.target AND round(a.edge_score * b.edge_score * 0.7, 4) >= 0.01)"""


def _paths(spark, d):
    e = edges(spark, d).withColumns({"support_count": F.col("n") - F.col("returned"), "contradiction_count": F.col("returned"), "source_diversity": F.col("suppliers")})
    return G.scored_paths(G.edge_scores(e, F.lit("2002-01-01").cast("date")))


@query(f"WITH {SCORED} SELECT source, coalesce(middle, -1) AS middle, target, score, sign, hops FROM paths")
def path_scores(spark, d):
    return _paths(spark, d).fillna({"middle": -1})


@query(f"""WITH {SCORED}, b AS (SELECT source, target, max(score) AS best_score, arg_max(sign, score * 10 + sign) AS sign, min(hops) AS hops, count(*) FILTER (sign > 0) AS positive_paths, count(*) FILTER (sign < 0) AS negative_paths FROM (SELECT source, target, score, sign, hops FROM paths) GROUP BY 1, 2)
SELECT source, target, best_score, (SELECT max(p.sign) FROM paths p WHERE p.source = b.source AND p.target = b.target AND p.score = b.best_score) AS sign, hops, positive_paths, negative_paths, CASE WHEN positive_paths > 0 AND negative_paths > 0 THEN 'mixed' WHEN positive_paths > 0 THEN 'beneficiary' ELSE 'at_risk' END AS role FROM b""")
def thematic_baskets(spark, d):
    return G.baskets(_paths(spark, d))


@query(f"""WITH {EDGES}, dn AS (SELECT source AS node, list_sort(list(DISTINCT target)) AS t FROM edges GROUP BY 1), up AS (SELECT target AS node, list_sort(list(DISTINCT source)) AS s FROM edges GROUP BY 1)
SELECT coalesce(dn.node, up.node) AS node, array_to_string(t, ',') AS targets, array_to_string(s, ',') AS sources FROM dn FULL JOIN up ON dn.node = up.node""")
def path_cache(spark, d):
    join = lambda c: F.when(F.col(c).isNotNull(), F.concat_ws(",", F.col(c).cast("array<string>"))).alias(c)
    return G.adjacency(edges(spark, d)).select("node", join("targets"), join("sources"))


@query("""WITH s AS (SELECT s_nationkey % 5 AS source, s_suppkey % 3 AS target, CASE WHEN s_acctbal > 0 THEN 'supplies' ELSE 'blocks' END AS relation, s_acctbal / 10000 AS confidence, s_suppkey % 4 <> 0 AS active, 'o' || CAST(s_suppkey % 2 AS VARCHAR) AS origin FROM supplier)
SELECT source, target, relation, round(max(confidence), 6) AS confidence, array_to_string(list_sort(list(DISTINCT origin)), ',') AS origins, count(*) AS supports FROM s WHERE active GROUP BY 1, 2, 3""")
def edge_supports(spark, d):
    s = table(spark, d, "supplier").select((F.col("s_nationkey") % 5).alias("source"), (F.col("s_suppkey") % 3).alias("target"), F.when(F.col("s_acctbal") > 0, "supplies").otherwise("blocks").alias("relation"), (F.col("s_acctbal") / 10000).alias("confidence"), (F.col("s_suppkey") % 4 != 0).alias("active"), F.concat(F.lit("o"), (F.col("s_suppkey") % 2).cast("string")).alias("origin"))
    return G.refreshed_edges(s).select("source", "target", "relation", F.round("confidence", 6).alias("confidence"), F.concat_ws(",", "origins").alias("origins"), "supports")
