"""Mutations as append-only revisions: nothing is overwritten but the end of a head's validity.

A revision table has chain, version, state, valid_from, valid_until and any value columns. Heads are the
highest version of a chain. Changes to chains without a head change nothing. Nulls in the chain are
chains of their own that no change reaches; of several changes to one chain give one. Empty tables give
no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIVE, SUPERSEDED, RETRACTED, MERGED = "Active", "Superseded", "Retracted", "Merged"


def heads(revisions: DataFrame) -> DataFrame:
    """The highest version of each chain. Its key alone is aggregated; rows are joined to it."""
    top = revisions.groupBy("chain").agg(F.max("version").alias("version"))
    return revisions.join(top, ["chain", "version"], "left_semi")


def successor(revisions: DataFrame, changes: DataFrame, at: Column, state: str = LIVE, closed: str = SUPERSEDED) -> DataFrame:
    """``revisions`` with a next version of each chain in ``changes`` (chain and new values); other
    values go on. The former head's validity ends at ``at`` and its state becomes ``closed``."""
    new = [c for c in changes.columns if c != "chain"]
    live = heads(revisions).where(F.col("state") == LIVE)
    given = live.join(changes.select("chain", *[F.col(c).alias(f"new_{c}") for c in new]), "chain")
    fixed = {"version": F.col("version") + 1, "state": F.lit(state), "valid_from": at, "valid_until": F.lit(None).cast(revisions.schema["valid_until"].dataType)}
    made = given.select(*[(fixed[c] if c in fixed else F.col(f"new_{c}") if c in new else F.col(c)).alias(c) for c in revisions.columns])
    touched = given.select("chain", "version", F.lit(True).alias("closing"))
    old = revisions.join(touched, ["chain", "version"], "left")
    end = F.coalesce("closing", F.lit(False))
    kept = old.withColumns({"state": F.when(end, F.lit(closed)).otherwise(F.col("state")), "valid_until": F.when(end, at).otherwise(F.col("valid_until"))})
    return kept.select(*revisions.columns).unionByName(made)


def retract(revisions: DataFrame, chains: DataFrame, at: Column) -> DataFrame:
    """A tombstone revision at the end of each of ``chains`` (chain)."""
    return successor(revisions, chains.select("chain"), at, state=RETRACTED)


def without_nodes(edges: DataFrame, gone: DataFrame, ends: tuple[str, ...] = ("source", "target")) -> DataFrame:
    """``edges`` (source, target, ...) that don't touch a node of ``gone`` (node) with one of ``ends``:
    where only sources are of the kind of ``gone``, a target may have the id of one and yet be another node."""
    left = edges
    for end in ends:
        left = left.join(gone.select(F.col("node").alias(end)), end, "left_anti")
    return left.select(*edges.columns)


def merge(revisions: DataFrame, pairs: DataFrame, at: Column) -> tuple[DataFrame, DataFrame]:
    """(revisions, edges): each source of ``pairs`` (source, target; distinct, both live) gets a last
    revision that points to its target in ``merged_into``; edges say what the target derives from."""
    live = heads(revisions).where(F.col("state") == LIVE).select("chain")
    sound = pairs.where(F.col("source") != F.col("target")).join(live.withColumnRenamed("chain", "source"), "source", "left_semi").join(live.withColumnRenamed("chain", "target"), "target", "left_semi")
    base = revisions if "merged_into" in revisions.columns else revisions.withColumn("merged_into", F.lit(None).cast(pairs.schema["target"].dataType))
    out = successor(base, sound.select(F.col("source").alias("chain"), F.col("target").alias("merged_into")), at, state=MERGED)
    edges = sound.select(F.col("target").alias("source"), F.col("source").alias("target"), F.lit("DerivedFrom").alias("relation"), F.lit(1.0).alias("weight"))
    return out, edges


def store_unique(stored: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """``stored`` and those rows of ``new`` whose keys it lacks, the first by ``order`` of equal ones."""
    fresh = new.join(stored.select(*keys).distinct(), keys, "left_anti")
    first = fresh.groupBy(*keys).agg(F.min(order).alias("_first")).withColumnRenamed("_first", order)
    return stored.unionByName(fresh.join(first, [*keys, order], "left_semi").select(*stored.columns))


def connect(edges: DataFrame, new: DataFrame, most: int = 512) -> DataFrame:
    """``edges`` (source, target, relation, weight) and ``new`` ones, weights held in 0 .. 1; an edge
    that is there keeps its place. Of a node's new edges the heaviest are added, up to ``most`` in all."""
    keys = ["source", "target", "relation"]
    fresh = new.groupBy(*keys).agg(F.max("weight").alias("weight")).withColumn("weight", F.greatest(F.least("weight", F.lit(1.0)), F.lit(0.0))).join(edges.select(*keys), keys, "left_anti")
    have = edges.groupBy("source").agg(F.count("*").alias("have"))
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("weight"), "target", "relation"))
    room = fresh.join(have, "source", "left").withColumn("place", place).where(F.col("place") + F.coalesce("have", F.lit(0)) <= most)
    return edges.select(*keys, "weight").unionByName(room.select(*keys, "weight"))


def purge_agent(rows: DataFrame, edges: DataFrame, agent: Column, id: str, ends: tuple[str, ...] = ("source", "target")) -> tuple[DataFrame, DataFrame]:
    """(rows, edges) without what an agent wrote and the edges that have it at one of ``ends``; a null agent stays."""
    gone = rows.where(F.coalesce(agent, F.lit(False))).select(F.col(id).alias("node"))
    return rows.where(~F.coalesce(agent, F.lit(False))), without_nodes(edges, gone, ends)
