"""Personalised ranks on blocks of a graph, in numpy.

A node lies in the bucket of its hash. A chunk holds edges whose sources lie in one bucket: places of sources
and targets in its own short lists, and weights. Each round a bucket's ranks go to its chunks, and each chunk
sends every other bucket one sum for each node it reaches there, so that chunks stay where they are and no
edge is shuffled, sorted or hashed again. A task holds one chunk and the ranks of its buckets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.sources.settled import discard, settled

#: Stands for a null id, which no edge leaves.
NOTHING = -(2**63)
LAID = "bucket int, chunk long, role int, a binary, b binary, c binary, d binary"
NODES = "bucket int, chunk long, role int, size int, a binary, b binary, c binary"
SUMS = "bucket int, chunk long, sums binary"
RANKS = "bucket int, ranks binary, change double, lost double"
EDGES, READS, GETS, SEEDS, OWN = range(5)


def _schema(ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in ddl.split(", "))])


def _batch(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    schema = _schema(ddl)
    return pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def _array(column: pa.Array, k: int, kind: str) -> np.ndarray:
    return np.frombuffer(column[k].as_buffer() or b"", dtype=kind)


def _chunked(most: int):
    """Edges (bucket, source, to, target, weight) of one bucket a task -> rows ``LAID``."""

    def laid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, number = [], 0, 0

        def chunk() -> pa.RecordBatch:
            nonlocal held, n, number
            bucket, source, to, target, weight = (np.concatenate(x) for x in zip(*held, strict=True))
            if bucket.min() != bucket.max():
                raise ValueError("edges of several buckets in one task")
            here = int(bucket[0])
            name = here << 32 | number
            froms, source = np.unique(source, return_inverse=True)
            order = np.lexsort((target, to))
            to, target = to[order], target[order]
            new = np.append(True, (to[1:] != to[:-1]) | (target[1:] != target[:-1]))
            place = np.empty(n, np.int32)
            place[order] = np.cumsum(new) - 1
            to, target = to[new], target[new]
            cuts = np.flatnonzero(np.append(True, to[1:] != to[:-1]))
            goes = np.stack((to[cuts], cuts)).astype(np.int32)
            rows = [(here, name, EDGES, source.astype(np.int32).tobytes(), place.tobytes(), weight.tobytes(), goes.tobytes())]
            rows.append((here, name, READS, froms.tobytes(), np.bincount(source, weight).tobytes(), None, None))
            rows += [(int(k), name, GETS, ids.tobytes(), None, None, None) for k, ids in zip(to[cuts].tolist(), np.split(target, cuts[1:]), strict=True)]
            held, n, number = [], 0, number + 1
            return _batch(rows, LAID)

        for batch in batches:
            held.append([np.asarray(x) for x in batch.columns])
            n += batch.num_rows
            if n >= most:
                yield chunk()
        if n:
            yield chunk()

    return laid


def _seed_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bucket, node = (np.asarray(x) for x in batch.columns)
        yield _batch([(int(k), -1, SEEDS, node[bucket == k].tobytes(), None, None, None) for k in np.unique(bucket)], LAID) if len(bucket) else _batch([(0, -1, SEEDS, b"", None, None, None)], LAID)


def _numbered(one: float):
    """The lists of ids that meet in a bucket -> its nodes (ids, share of the seeds, weight of what leaves
    them) and each list's places among these."""

    def numbered(table: pa.Table) -> pa.Table:
        bucket, chunk, role = (table.column(k).to_pylist() for k in range(3))
        a, b = table.column(3).combine_chunks(), table.column(4).combine_chunks()
        lists = [_array(a, k, "<i8") for k in range(len(role))]
        ids, home = np.unique(np.concatenate(lists)), None
        places = [np.searchsorted(ids, x).astype(np.int32) for x in lists]
        home, total = np.zeros(len(ids)), np.zeros(len(ids))
        for k, kind in enumerate(role):
            if kind == SEEDS:
                home[places[k]] = one
            elif kind == READS:
                total[places[k]] += _array(b, k, "<f8")
        rows = [(bucket[0], -1, OWN, len(ids), ids.tobytes(), home.tobytes(), total.tobytes())]
        rows += [(bucket[0], chunk[k], kind, len(ids), places[k].tobytes(), total[places[k]].tobytes() if kind == READS else None, None) for k, kind in enumerate(role) if kind != SEEDS]
        return pa.Table.from_batches([_batch(rows, NODES)])

    return numbered


def _sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks with their places and totals and the ranks of their bucket -> bucket, chunk, sums."""
    for batch in batches:
        name, source, target, weight, goes, place, total, ranks = batch.columns
        for k in range(batch.num_rows):
            held, given = _array(total, k, "<f8"), _array(ranks, k, "<f8")[_array(place, k, "<i4")]
            given = np.divide(given, held, out=np.zeros(len(given)), where=held != 0)
            if not given.any():
                continue
            sums = np.bincount(_array(target, k, "<i4"), _array(weight, k, "<f8") * given[_array(source, k, "<i4")])
            to, cuts = _array(goes, k, "<i4").reshape(2, -1)
            chunk = name[k].as_py()
            yield _batch([(b, chunk, part.tobytes()) for b, part in zip(to.tolist(), np.split(sums, cuts[1:]), strict=True)], SUMS)


def _summed(teleport: float, lost: float):
    """A bucket's nodes and places with what was sent to it -> bucket, ranks, change, lost."""

    def summed(places: pa.Table, sent: pa.Table) -> pa.Table:
        names, a, b, c = (places.column(name).combine_chunks() for name in ("chunk", "a", "b", "c"))
        row = {name: k for k, name in enumerate(names.to_pylist())}
        got, was = np.zeros(places.column("size")[0].as_py()), None
        sums = sent.column("sums").combine_chunks()
        for k, name in enumerate(sent.column("chunk").to_pylist()):
            if name < 0:
                was = _array(sums, k, "<f8")
            else:
                got[_array(a, row[name], "<i4")] += _array(sums, k, "<f8")
        home, ends = _array(b, row[-1], "<f8"), _array(c, row[-1], "<f8") == 0
        ranks = home * (teleport + (1 - teleport) * lost) + (1 - teleport) * got
        change = 0.0 if was is None else float(np.abs(ranks - was).max(initial=0.0))
        return pa.Table.from_batches([_batch([(places.column("bucket")[0].as_py(), ranks.tobytes(), change, float(ranks[ends].sum()))], RANKS)])

    return summed


def _listed(least: float):
    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ids, ranks = _array(batch.column(0), k, "<i8"), _array(batch.column(1), k, "<f8")
                ids, ranks = ids[ranks > least], ranks[ranks > least]
                for at in range(0, len(ids), 100_000):
                    part = ids[at : at + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array(part, mask=part == NOTHING), pa.array(ranks[at : at + 100_000])], ["node", "rank"])

    return listed


def personalised_rank(edges: DataFrame, seeds: DataFrame, teleport: float = 0.15, settle: float = 1e-6, most_rounds: int = 100, least: float = 1e-10, at_once: int = 8, block: int = 1_000_000) -> DataFrame:
    """node, rank by personalised PageRank from uniform seeds over what they reach: weights are shares
    of a node's out-edges, what dangling nodes hold goes back to the seeds, as it does where all
    out-edges weigh nothing. Ids are whole numbers. Rounds go on until no rank changes by ``settle``.
    Ranks are written every ``at_once`` rounds, or every round where there are dangling nodes, whose
    sum the next round needs. Ranks of ``least`` or less are left out. Without seeds: no rows. There is
    a bucket for every ``block`` edges."""
    spark = edges.sparkSession
    kind, parts = seeds.schema["node"].dataType, int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(1, -(-edges.count() // block))
    number = lambda name: F.coalesce(F.col(name).cast("long"), F.lit(NOTHING))
    in_bucket = lambda name: F.pmod(F.hash(name), F.lit(buckets))

    starts = settled(seeds.select(number("node").alias("node")).distinct())
    n = starts.count()
    # Spark parts rows by this very hash, so a task has one bucket.
    plain = edges.where("source is not null").select(number("source").alias("source"), number("target").alias("target"), F.coalesce(F.col("weight").cast("double"), F.lit(0.0)).alias("weight")).repartition(buckets, "source")
    laid = settled(plain.select(in_bucket("source").alias("bucket"), "source", in_bucket("target").alias("to"), "target", "weight").mapInArrow(_chunked(2 * block), LAID))
    lists = laid.where(F.col("role") != EDGES).unionByName(starts.select(in_bucket("node").alias("bucket"), "node").mapInArrow(_seed_lists, LAID))
    nodes = settled(lists.groupBy("bucket").applyInArrow(_numbered(1.0 / max(n, 1)), NODES))
    reads = nodes.where(F.col("role") == READS).select("bucket", "chunk", F.col("a").alias("place"), F.col("b").alias("total")).hint("shuffle_hash")
    chunks = laid.where(F.col("role") == EDGES).select("bucket", "chunk", *"abcd").join(reads, ["bucket", "chunk"]).repartition(parts, "bucket").persist(StorageLevel.DISK_ONLY)
    gets = nodes.where(F.col("role").isin(GETS, OWN)).drop("role").repartition(parts, "bucket").sortWithinPartitions("bucket").persist(StorageLevel.DISK_ONLY)

    def summed(sums: DataFrame, lost: float) -> DataFrame:
        return gets.groupBy("bucket").cogroup(sums.groupBy("bucket")).applyInArrow(_summed(teleport, lost), RANKS)

    # With everything lost, the seeds get all there is: the ranks before the first round.
    ranks = settled(summed(spark.createDataFrame([], SUMS), 1.0))
    dangling = not nodes.where(F.col("role") == OWN).select("c").mapInArrow(_weighs_nothing, "dangling boolean").where("dangling").isEmpty()
    steps = 1 if dangling else at_once
    for done in range(0, most_rounds, steps):
        before, lost = ranks, (ranks.agg(F.sum("lost")).first()[0] or 0.0) if dangling else 0.0
        rounds = min(steps, most_rounds - done)
        for step in range(rounds):
            sums = chunks.join(ranks.select("bucket", "ranks").hint("shuffle_hash"), "bucket").select("chunk", *"abcd", "place", "total", "ranks").mapInArrow(_sent, SUMS)
            if step == rounds - 1:  # what the ranks were, to see what this round changes
                sums = sums.unionByName(ranks.select("bucket", F.lit(-1).cast("long").alias("chunk"), F.col("ranks").alias("sums")))
            ranks = summed(sums, lost)
        ranks = settled(ranks)
        discard(before)
        if (ranks.agg(F.max("change")).first()[0] or 0.0) < settle:
            break
    out = settled(gets.where("chunk < 0").join(ranks, "bucket").select("a", "ranks").mapInArrow(_listed(least), "node long, rank double").select(F.col("node").cast(kind).alias("node"), "rank"))
    for cached in (chunks, gets):
        cached.unpersist()
    discard(starts, laid, nodes, ranks)
    return out


def _weighs_nothing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([bool((_array(batch.column(0), k, "<f8") == 0).any()) for k in range(batch.num_rows)], pa.bool_())], ["dangling"])
