"""Exact top-k neighbours of binary codes by incremental multi-index hashing.

A code of 64 bits is cut into segments, each with a table of its own. Two codes within distance r
agree in some segment up to r // segments bits, so when all segments have been searched up to radius
s, every code within segments * (s + 1) - 1 has been seen. Radii grow until a query's k-th verified
distance is covered in that sense; ties at the k-th distance go by the smaller id.

Rows are indexed by task, queries go to all tasks in broadcast blocks of ``block`` codes, and each
task sends on its k best for each query; the k best of these are the result. Queries are a stated set
(every 20th id) against all rows.

Codes are the signs of the vector's elements (bit set where an element is above 0), so vectors of up
to 64 elements are taken as they are; longer ones are folded by seeded random directions.

Nulls: rows without an id or a vector, or with null elements, are in neither index nor queries. A row
is no neighbour of its own id; rows repeating an id are neighbours each. Queries with fewer than k
other rows get all of them. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import arrays, tables

BITS = 64


def code_of(vectors: np.ndarray, seed: int = 3) -> np.ndarray:
    """64-bit codes of [n, d] vectors."""
    if vectors.shape[1] > BITS:
        vectors = vectors @ np.random.default_rng(seed).standard_normal((vectors.shape[1], BITS)).astype(vectors.dtype)
    bits = np.zeros((len(vectors), BITS), dtype=np.uint8)
    bits[:, : vectors.shape[1]] = vectors > 0
    return np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel()


def codes(rows: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """id, code of each row that has both."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            sizes = np.diff(np.asarray(lists.offsets))
            for size in np.unique(sizes):
                rows = np.flatnonzero(sizes == size)
                part = lists.take(pa.array(rows))
                x = np.asarray(part.flatten(), dtype=np.float32).reshape(len(rows), int(size))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(code_of(x).view(np.int64))], ["id", "code"])

    whole = rows.where(F.col(key).isNotNull() & F.col(vector).isNotNull() & ~F.exists(vector, lambda x: x.isNull()))
    return whole.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("vector")).mapInArrow(work, "id long, code long")


class Segments:
    """Tables of one part's codes by segment."""

    def __init__(self, ids: np.ndarray, code: np.ndarray) -> None:
        self.ids, self.code = ids, code
        # Segments wide enough that a bucket holds few rows, and of a width that numpy has a type for.
        self.count = 8 if len(ids) < 1 << 16 else 4 if len(ids) < 1 << 26 else 2
        self.width = BITS // self.count
        self.kind = np.dtype(f"<u{self.width // 8}")
        self.order, self.keys = [], []
        parts = self._parts(code)
        for s in range(self.count):
            order = np.argsort(parts[:, s], kind="stable")
            self.order.append(order)
            self.keys.append(parts[order, s].astype(np.int64))

    def _parts(self, code: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(code).astype("<u8").view(self.kind).reshape(len(code), self.count)

    def nearest(self, query_ids: np.ndarray, query: np.ndarray, k: int, most: int = 2_000_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query index, row index, distance) of the k nearest rows of each query."""
        parts = self._parts(query).astype(np.int64)
        seen = np.zeros((len(query), BITS + 1), dtype=np.int64)  # rows found so far by distance
        worst = np.full(len(query), BITS)  # the k-th distance among them
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        open_q = np.arange(len(query))
        for radius in range(self.width + 1):
            masks = np.array([sum(1 << b for b in c) for c in combinations(range(self.width), radius)], dtype=np.int64)
            for s in range(self.count):
                fill = max(1, int(len(self.ids) * len(masks) / (1 << self.width)) + len(masks))
                step = max(1, most // fill)
                for a in range(0, len(open_q), step):
                    q = open_q[a : a + step]
                    key = (parts[q, s][:, None] ^ masks[None, :]).ravel()
                    lo, hi = np.searchsorted(self.keys[s], key, "left"), np.searchsorted(self.keys[s], key, "right")
                    rows = self.order[s][arrays.spread(lo, hi - lo)]
                    owner = np.repeat(np.repeat(q, len(masks)), hi - lo)
                    apart = query[owner] ^ self.code[rows]
                    each = np.bitwise_count(self._parts(apart))
                    # A row counts where it is first met: at its least segment distance, in the first such segment.
                    first = (each.min(1) == radius) & (each.argmin(1) == s) & (self.ids[rows] != query_ids[owner])
                    dist = each.sum(1, dtype=np.int64)
                    first &= dist <= worst[owner]
                    owner, rows, dist = owner[first], rows[first], dist[first]
                    seen += np.bincount(owner * (BITS + 1) + dist, minlength=seen.size).reshape(seen.shape)
                    enough = np.cumsum(seen[q], axis=1) >= k
                    worst[q] = np.where(enough[:, -1], enough.argmax(1), BITS)
                    near = dist <= worst[owner]
                    held.append((owner[near], rows[near], dist[near]))
            covered = self.count * (radius + 1) - 1
            open_q = open_q[(worst[open_q] > covered) | (seen[open_q].sum(1) < k)]
            if not len(open_q):
                break
        q, r, d = (np.concatenate(x) for x in zip(*held, strict=True))
        near = d <= worst[q]
        q, r, d = q[near], r[near], d[near]
        order = np.lexsort((r, self.ids[r], d, q))
        q, r, d = q[order], r[order], d[order]
        first = np.flatnonzero(np.diff(q, prepend=-1))
        place = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
        return q[place < k], r[place < k], d[place < k]


def top_k(rows: DataFrame, k: int = 10, every: int = 20, block: int = 200_000, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), neighbor_id, distance: the k nearest rows by Hamming distance of each
    row whose id is divisible by ``every``."""
    spark = rows.sparkSession
    index = tables.written(codes(rows, key, vector), "codes")
    queries = index.where(F.col("id") % every == 0).dropDuplicates(["id", "code"])
    blocks = max(1, -(-queries.count() // block))
    found = None
    for b in range(blocks):
        part = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("id", "code"), F.lit(blocks)) == b)
        got = part.toPandas().sort_values(["id", "code"])
        shared = spark.sparkContext.broadcast((got["id"].to_numpy(np.int64), got["code"].to_numpy(np.int64).view(np.uint64)))

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, query = shared.value
            held = [(np.asarray(x.column(0)), np.asarray(x.column(1)).view(np.uint64)) for x in batches]
            if not held or not len(ids):
                return
            table = Segments(np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held]))
            for a in range(0, len(ids), 1024):
                q, r, d = table.nearest(ids[a : a + 1024], query[a : a + 1024], k)
                yield pa.RecordBatch.from_arrays([pa.array(ids[a + q]), pa.array(query[a + q].view(np.int64)), pa.array(table.ids[r]), pa.array(table.code[r].view(np.int64)), pa.array(d)], ["query_id", "query", "neighbor_id", "neighbor", "distance"])

        near = index.mapInArrow(search, "query_id long, query long, neighbor_id long, neighbor long, distance long")
        found = near if found is None else found.unionByName(near)
    place = Window.partitionBy("query_id", "query").orderBy("distance", "neighbor_id", "neighbor")
    return found.withColumn("rank", F.row_number().over(place).cast("long")).where(F.col("rank") <= k).select("query_id", "rank", "neighbor_id", "distance")


ORACLE = """
WITH codes AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS bits FROM embeddings),
pairs AS (
  SELECT q.id AS query_id, r.id AS neighbor_id,
         CAST(list_sum(list_transform(list_zip(q.bits, r.bits), lambda z: CASE WHEN z[1] <> z[2] THEN 1 ELSE 0 END)) AS BIGINT) AS distance
  FROM codes q JOIN codes r ON q.id % 20 = 0 AND q.id <> r.id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS rank FROM pairs)
SELECT query_id, rank, neighbor_id, distance FROM ranked WHERE rank <= 10
"""
