"""Graph queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.operators import graph
from recollect.sources.settled import settled
from recollect.sources.views import causal_edges, supply_edges

from .register import registry

QUERIES, ORACLE, query = registry()
C = F.col
SUPPLY = """WITH RECURSIVE sums AS (SELECT l_partkey AS p, l_suppkey AS s, sum(l_quantity) AS q, count(*) AS n FROM lineitem GROUP BY 1, 2),
edges AS (SELECT p AS source, s + 1000000 AS target, q/(SELECT max(q) FROM sums) AS weight, n AS evidence FROM sums)"""
CAUSAL = """WITH RECURSIVE ev AS (SELECT user_id, ts, event_id, user_id*10 + CASE event_type WHEN 'click' THEN 1 WHEN 'error' THEN 2 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 4 ELSE 5 END AS node FROM events),
st AS (SELECT node, lead(node) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM ev),
ce AS (SELECT node AS cause, nxt AS effect, count(*) AS evidence FROM st WHERE nxt > node GROUP BY 1, 2),
edges AS (SELECT cause, effect, least(evidence/10.0, 1.0) AS strength, least(0.3+0.7*(1-1.0/(1+evidence)), 1.0) AS confidence, evidence FROM ce),
chains AS (SELECT [cause, effect] AS path, effect, 1 AS depth, strength*confidence*ln(1+evidence) AS total, strength*confidence AS prob FROM edges WHERE cause % 50 = 1 AND confidence >= 0.3
 UNION ALL SELECT list_append(c.path, e.effect), e.effect, c.depth + 1, c.total + e.strength*e.confidence*ln(1+e.evidence), c.prob*e.strength*e.confidence FROM chains c JOIN edges e ON e.cause = c.effect WHERE c.depth < 3 AND e.confidence >= 0.3 AND NOT list_contains(c.path, e.effect))"""


def _both(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Supply edges, computed once, and these in both directions."""
    e = settled(supply_edges(spark, sf_dir).select("source", "target", "weight"), "edges")
    return e, e.unionByName(e.select(C("target").alias("source"), C("source").alias("target"), "weight"))


def _seeds(supplies: DataFrame, every: int) -> DataFrame:
    """Every so many parts. ``supplies`` holds edges from parts only: past a million parts a node's id doesn't tell its kind."""
    return supplies.where(C("source") % every == 0).select(C("source").alias("node")).distinct()


@query(SUPPLY + """, seeds AS (SELECT DISTINCT source AS node FROM edges WHERE source % 50 = 0),
a AS (SELECT node, CAST(1.0 AS DOUBLE) AS score FROM seeds UNION ALL SELECT target, max(weight) FROM edges JOIN seeds ON source = node GROUP BY target)
SELECT node, round(max(score), 6) AS score FROM a GROUP BY node""")
def static_activation(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = supply_edges(spark, sf_dir)
    return graph.neighbours(e, _seeds(e, 50)).select("node", F.round("score", 6).alias("score"))


@query(SUPPLY + """, b AS (SELECT source, target, weight FROM edges UNION ALL SELECT target, source, weight FROM edges),
s0 AS (SELECT DISTINCT source AS node, 1.0 AS score FROM edges WHERE source % 200 = 0),
l1 AS (SELECT target AS node, least(sum(give), 1.0) AS more FROM (SELECT target, score*weight*0.7 AS give FROM s0 JOIN b ON node = source) WHERE give >= 0.01 GROUP BY 1),
s1 AS (SELECT coalesce(s0.node, l1.node) AS node, least(coalesce(score, 0) + coalesce(more, 0), 1.0) AS score, CASE WHEN s0.node IS NULL THEN 1 ELSE 0 END AS depth FROM s0 FULL JOIN l1 ON s0.node = l1.node),
l2 AS (SELECT target AS node, least(sum(give), 1.0) AS more FROM (SELECT target, score*weight*0.49 AS give FROM s1 JOIN b ON node = source WHERE depth = 1) WHERE give >= 0.01 GROUP BY 1),
s2 AS (SELECT coalesce(s1.node, l2.node) AS node, least(coalesce(score, 0) + coalesce(more, 0), 1.0) AS score, coalesce(depth, 2) AS depth FROM s1 FULL JOIN l2 ON s1.node = l2.node)
SELECT node, depth, round(score, 6) AS score FROM s2 WHERE score >= 0.01""")
def spreading_activation(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, b = _both(spark, sf_dir)
    return graph.spread(b, _seeds(e, 200), depth=2).select("node", "depth", F.round("score", 6).alias("score"))


@query(SUPPLY + """, b AS (SELECT source, target FROM edges WHERE weight >= 0.3 UNION ALL SELECT target, source FROM edges WHERE weight >= 0.3),
s AS (SELECT DISTINCT source AS node FROM edges WHERE source % 100 = 0),
d1 AS (SELECT DISTINCT target AS node FROM s JOIN b ON node = source WHERE target NOT IN (SELECT node FROM s)),
d2 AS (SELECT DISTINCT target AS node FROM d1 JOIN b ON node = source WHERE target NOT IN (SELECT node FROM s) AND target NOT IN (SELECT node FROM d1)),
d3 AS (SELECT DISTINCT target AS node FROM d2 JOIN b ON node = source WHERE target NOT IN (SELECT node FROM s) AND target NOT IN (SELECT node FROM d1) AND target NOT IN (SELECT node FROM d2))
SELECT node, 1 AS depth FROM d1 UNION ALL SELECT node, 2 FROM d2 UNION ALL SELECT node, 3 FROM d3""")
def traverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, b = _both(spark, sf_dir)
    return graph.traverse(b, _seeds(e, 100), 3, 0.3)


@query()
def personalised_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks from every fiftieth part, until they settle; tested against a plain loop."""
    e, b = _both(spark, sf_dir)
    return graph.personalised_rank(b, _seeds(e, 50)).select("node", F.round("rank", 8).alias("rank"))


@query(CAUSAL + " SELECT array_to_string(path, '>') AS path, depth, round(total/depth, 6) AS score, round(prob, 6) AS probability FROM chains")
def causal_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = causal_edges(spark, sf_dir)
    found = graph.causal_chains(e, e.where("cause % 50 = 1").select(C("cause").alias("node")).distinct())
    return found.select(F.array_join("path", ">").alias("path"), "depth", F.round("score", 6).alias("score"), F.round("probability", 6).alias("probability"))


@query(CAUSAL + ", r AS (SELECT path[1] AS cause, effect, max(prob) AS p, max(total/depth) AS s FROM chains GROUP BY 1, 2) SELECT cause, effect, round(p, 6) AS probability, round(s, 6) AS score FROM r")
def what_if(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The likeliest way from each intervention to each outcome it reaches."""
    e = causal_edges(spark, sf_dir)
    found = graph.causal_chains(e, e.where("cause % 50 = 1").select(C("cause").alias("node")).distinct())
    return found.groupBy(C("path")[0].alias("cause"), "effect").agg(F.round(F.max("probability"), 6).alias("probability"), F.round(F.max("score"), 6).alias("score"))


@query(CAUSAL + """, f AS (SELECT path[1] AS cause, effect, max(prob) AS factual, max(CASE WHEN NOT list_contains(path, path[1] + 1) THEN prob ELSE 0 END) AS other FROM chains GROUP BY 1, 2)
SELECT cause, effect, round(greatest(0.0, least(1.0, 1 - other/factual)), 6) AS necessity FROM f""")
def counterfactual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much each outcome hangs on going through the node after its cause."""
    e = causal_edges(spark, sf_dir)
    found = graph.causal_chains(e, e.where("cause % 50 = 1").select(C("cause").alias("node")).distinct())
    without = F.when(~F.array_contains("path", C("path")[0] + 1), C("probability")).otherwise(0.0)
    g = found.groupBy(C("path")[0].alias("cause"), "effect").agg(F.max("probability").alias("factual"), F.max(without).alias("other"))
    return g.select("cause", "effect", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - C("other") / C("factual"))), 6).alias("necessity"))


@query(SUPPLY + """, r AS (SELECT DISTINCT source AS node FROM edges WHERE source % 3 = 0 UNION SELECT DISTINCT target FROM edges WHERE target % 2 = 0)
SELECT source, target, round(CASE WHEN a AND b THEN least(weight + 0.05, 1.0) WHEN a OR b THEN greatest(weight*0.99, 0.01) ELSE weight END, 6) AS weight, a AND b AS together
FROM (SELECT *, source IN (SELECT node FROM r) AS a, target IN (SELECT node FROM r) AS b FROM edges)""")
def hebbian_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = supply_edges(spark, sf_dir).select("source", "target", "weight")
    hit = e.where("source % 3 = 0").select(C("source").alias("node")).union(e.where("target % 2 = 0").select("target"))
    return graph.hebbian(e, hit).select("source", "target", F.round("weight", 6).alias("weight"), "together")


@query(SUPPLY + " SELECT source, target, round(weight*exp(-0.01*evidence*24), 6) AS weight FROM edges WHERE weight*exp(-0.01*evidence*24) >= 0.05")
def edge_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = supply_edges(spark, sf_dir).withColumn("weight", C("weight") * F.exp(-0.01 * C("evidence") * 24))
    return e.where(C("weight") >= 0.05).select("source", "target", F.round("weight", 6).alias("weight"))


@query(SUPPLY + ", t AS (SELECT source AS node, count(*) AS degree, sum(weight) AS strength FROM edges GROUP BY 1) SELECT node, degree, round(strength, 6) AS strength FROM t")
def node_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return supply_edges(spark, sf_dir).groupBy(C("source").alias("node")).agg(F.count("*").alias("degree"), F.round(F.sum("weight"), 6).alias("strength"))


@query()
def communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Communities of parts and suppliers by label propagation; tested against a plain loop."""
    return graph.label_communities(supply_edges(spark, sf_dir).where("weight >= 0.5"), rounds=4)
