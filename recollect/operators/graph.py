"""Graph operators as frontier joins over an edge table (source, target, weight, ...)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.functions import scoring, text
from recollect.operators.ranks import personalised_rank as personalised_rank
from recollect.sources.settled import settled as _settled


def neighbours(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """node, score: seeds at 1, one-hop targets at their heaviest edge."""
    out = edges.join(seeds.select(F.col("node").alias("source")), "source").groupBy(F.col("target").alias("node")).agg(F.max("weight").alias("score"))
    return seeds.select("node", F.lit(1.0).alias("score")).unionByName(out).groupBy("node").agg(F.max("score").alias("score"))


def spread(edges: DataFrame, seeds: DataFrame, depth: int = 3, decay: float = 0.7, least: float = 0.01) -> DataFrame:
    """node, score, depth by spreading activation: a node passes on act * weight * decay^(d+1) once,
    at the depth it is first reached; contributions under ``least`` are lost, sums are held at 1."""
    seen = seeds.select("node", F.lit(1.0).alias("score"), F.lit(0).alias("depth"))
    frontier = seen
    for d in range(depth):
        given = frontier.join(edges, frontier["node"] == edges["source"]).select(F.col("target").alias("node"), (F.col("score") * F.col("weight") * decay ** (d + 1)).alias("give")).where(F.col("give") >= least)
        level = given.groupBy("node").agg(F.least(F.sum("give"), F.lit(1.0)).alias("more"))
        joined = seen.join(level, "node", "full_outer")
        merged = joined.select("node", F.least(F.coalesce("score", F.lit(0.0)) + F.coalesce("more", F.lit(0.0)), F.lit(1.0)).alias("score"), F.coalesce("depth", F.lit(d + 1)).alias("depth"))
        seen = _settled(merged)
        frontier = seen.where(F.col("depth") == d + 1)
    return seen.where(F.col("score") >= least)


def traverse(edges: DataFrame, seeds: DataFrame, depth: int, least_weight: float = 0.0) -> DataFrame:
    """node, depth of what is reached along edges of enough weight; the seeds themselves not included."""
    kept = edges.where(F.col("weight") >= least_weight).select("source", "target")
    seen = seeds.select("node", F.lit(0).alias("depth")).distinct()
    frontier = seen
    for d in range(depth):
        step = frontier.join(kept, F.col("node") == F.col("source")).select(F.col("target").alias("node")).distinct()
        new = step.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(d + 1))
        seen = _settled(seen.unionByName(new))
        frontier = seen.where(F.col("depth") == d + 1)
    return seen.where(F.col("depth") > 0)


def causal_chains(edges: DataFrame, seeds: DataFrame, depth: int = 3, least_confidence: float = 0.3) -> DataFrame:
    """path, effect, depth, score, probability: simple paths from the seeds along causal edges (cause,
    effect, strength, confidence, evidence). score averages strength * confidence * ln(1 + evidence),
    probability multiplies strength * confidence."""
    kept = edges.where(F.col("confidence") >= least_confidence).select("cause", "effect", (F.col("strength") * F.col("confidence")).alias("p"), (F.col("strength") * F.col("confidence") * F.log1p(F.greatest("evidence", F.lit(1)))).alias("s"))
    here = seeds.select(F.array("node").alias("path"), F.col("node").alias("at"), F.lit(0.0).alias("sum"), F.lit(1.0).alias("prob"))
    found = None
    for d in range(1, depth + 1):
        here = _settled(here.join(kept, F.col("at") == F.col("cause")).where(~F.array_contains("path", F.col("effect"))).select(F.concat("path", F.array("effect")).alias("path"), F.col("effect").alias("at"), (F.col("sum") + F.col("s")).alias("sum"), (F.col("prob") * F.col("p")).alias("prob")))
        level = here.select("path", F.col("at").alias("effect"), F.lit(d).alias("depth"), (F.col("sum") / d).alias("score"), F.col("prob").alias("probability"))
        found = level if found is None else found.unionByName(level)
    return found


def hebbian(edges: DataFrame, retrieved: DataFrame, rate: float = 0.05, decay: float = 0.01, floor: float = 0.01) -> DataFrame:
    """Edges whose two ends were retrieved together grow, those with one end retrieved fade."""
    r = retrieved.select(F.col("node").alias("r")).distinct()
    a = edges.join(r.select(F.col("r").alias("ra")), F.col("source") == F.col("ra"), "left").join(r.select(F.col("r").alias("rb")), F.col("target") == F.col("rb"), "left")
    ends = F.col("ra").isNotNull().cast("int") + F.col("rb").isNotNull().cast("int")
    weight = F.when(ends == 2, F.least(F.col("weight") + rate, F.lit(1.0))).when(ends == 1, F.greatest(F.col("weight") * (1 - decay), F.lit(floor))).otherwise(F.col("weight"))
    return a.withColumn("weight", weight).withColumn("together", (ends == 2)).drop("ra", "rb")


def label_communities(edges: DataFrame, rounds: int = 5) -> DataFrame:
    """node, community by weighted label propagation: each round a node takes the label with the most
    weight around it, ties to the smaller label."""
    both = edges.select(F.col("source").alias("a"), F.col("target").alias("b"), "weight").unionByName(edges.select(F.col("target").alias("a"), F.col("source").alias("b"), "weight"))
    labels = both.select(F.col("a").alias("node")).distinct().withColumn("community", F.col("node"))
    for _ in range(rounds):
        votes = both.join(labels, F.col("b") == F.col("node")).groupBy("a", "community").agg(F.round(F.sum("weight"), 9).alias("w"))
        labels = _settled(votes.groupBy(F.col("a").alias("node")).agg((-F.max(F.struct("w", (-F.col("community")).alias("c")))["c"]).alias("community")))
    return labels


def shortest_paths(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """node, hops: the fewest edges from any seed."""
    return traverse(edges, seeds, depth).withColumnRenamed("depth", "hops")


def subgraph(edges: DataFrame, nodes: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """The edges both of whose ends are among ``nodes``; with ``targets``, for two kinds of nodes whose
    ids may coincide, the sources among ``nodes`` and the targets among those."""
    s = nodes.select(F.col("node").alias("source"))
    t = (nodes if targets is None else targets).select(F.col("node").alias("target"))
    return edges.join(s, "source", "left_semi").join(t, "target", "left_semi").select(*edges.columns)


def provenance(found: DataFrame, edges: DataFrame, depth: int, most: int | None = None) -> DataFrame:
    """node, score, level of what result rows (node, score) derive from along ``edges`` (source,
    target), level by level: half the lowest result score (at least 0.01) over the level plus two.
    Results themselves are not displaced."""
    base = found.agg(F.greatest(0.5 * F.min("score"), F.lit(0.01)).alias("base"))
    reached = traverse(edges.withColumn("weight", F.lit(1.0)), found.select("node"), depth)
    out = reached.crossJoin(F.broadcast(base)).select("node", (F.col("base") / (F.col("depth") - 1 + 2)).alias("score"), (F.col("depth") - 1).alias("level"))
    return out if most is None else out.orderBy(F.desc("score"), "node").limit(most)


def lateral_inhibition(activated: DataFrame, edges: DataFrame, seeds: DataFrame, vectors: DataFrame, strength: float = 0.5, near: float = 0.7) -> DataFrame:
    """``activated`` (node, score) where nodes further than two steps from every seed, but with a vector
    close to a seed's, lose score: for the closest seed, strength * (1 - Jaccard of neighbours) *
    cosine, of which at most 80 % of the score goes. ``seeds`` is a stated query set."""
    s = seeds.select("node").distinct()
    two = neighbours_within(edges, s, 2)
    far = activated.join(s, "node", "left_anti").join(two, "node", "left_anti")
    around = edges.groupBy(F.col("source").alias("node")).agg(F.collect_set("target").alias("around"))
    of_seed = s.join(vectors, "node").join(around, "node", "left").select(F.col("node").alias("seed"), F.col("embedding").alias("sv"), F.coalesce("around", F.expr("cast(array() as array<bigint>)")).alias("sa"))
    of_far = far.join(vectors, "node").join(around, "node", "left").withColumn("around", F.coalesce("around", F.expr("cast(array() as array<bigint>)")))
    met = of_far.join(F.broadcast(of_seed)).withColumn("cos", scoring.cosine(F.col("embedding"), F.col("sv"))).where(F.col("cos") > near)
    loss = met.select("node", (strength * (1 - text.jaccard(F.col("around"), F.col("sa"))) * F.col("cos")).alias("loss")).groupBy("node").agg(F.max("loss").alias("loss"))
    return activated.join(loss, "node", "left").select("node", (F.col("score") - F.least(F.coalesce("loss", F.lit(0.0)), 0.8 * F.col("score"))).alias("score"))


def neighbours_within(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """node: what is within ``depth`` steps of a seed, along edges as they point."""
    return traverse(edges.withColumn("weight", F.lit(1.0)), seeds, depth).select("node")


def activate(edges: DataFrame, seeds: DataFrame, records: DataFrame, mode: str = "spreading", most_seeds: int = 10, depth: int = 3) -> DataFrame:
    """Graph activation as a retrieval source: the best ``most_seeds`` result rows (node, score) seed
    the graph; what they activate is hydrated from ``records`` (node, ...) as ``activation_score``."""
    start = seeds.orderBy(F.desc("score"), "node").limit(most_seeds).select("node")
    found = neighbours(edges, start) if mode == "static" else spread(edges, start, depth).select("node", "score")
    return records.join(found.withColumnRenamed("score", "activation_score"), "node")
