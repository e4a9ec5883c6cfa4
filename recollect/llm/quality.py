"""Document quality by nearest-neighbour voting over latent-semantic vectors.

Terms are hashed byte trigrams plus a few terms for style (repeated word pairs, capitals, marks).
Labelled texts give inverse document frequencies and the latent axes (a truncated singular value
decomposition); their vectors, at most ``sample`` of them, are broadcast. Every document is projected
the same way, its cosines with all labelled vectors are computed in exact blocks, and the ``k``
nearest vote with their labels, weighted by similarity.

The classifier is fitted on at most ``sample`` labelled rows, those with the lowest hash of doc_id;
scoring covers every row and whole texts. Labels, languages, sources and ids never enter a score.

Nulls: null text is empty; an empty text has no neighbours and gets the share of label 1. Null or
other labels than 0 and 1 are not learnt from. Equal similarities go by position in hash order.
Repeated rows are scored each; extra columns are ignored. Without labelled rows every score is 0.5.
An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays, tables

TERMS = 4096
STYLE = 8
STYLE_WEIGHT = 40.0


def term_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """[documents, TERMS + STYLE]: trigram counts, then the style terms' shares."""
    size, docs = int(offsets[-1]), len(offsets) - 1
    lengths = np.diff(offsets) - 1
    owner = np.repeat(np.arange(docs), np.maximum(lengths - 2, 0))
    at = arrays.spread(offsets[:-1].astype(np.int64), np.maximum(lengths - 2, 0))
    wide = data.astype(np.uint32)
    code = (wide[at] << np.uint32(16)) | (wide[at + 1] << np.uint32(8)) | wide[at + 2]
    slot = (code * np.uint32(0x9E3779B1)) >> np.uint32(20)
    out = np.zeros((docs, TERMS + STYLE), dtype=np.float32)
    out[:, :TERMS] = np.bincount(owner * TERMS + slot, minlength=docs * TERMS).reshape(docs, TERMS)
    starts, ends = arrays.word_bounds(data, size)
    bounds = np.searchsorted(starts, offsets)
    words = np.diff(bounds)
    doc = np.repeat(np.arange(docs), words)
    h = arrays.hash_segments(data, starts, ends)
    some = np.maximum(words, 1).astype(np.float32)
    if len(h):
        pair = arrays.mix(h ^ arrays.mix(np.append(h[1:], h[:1]) + np.uint64(3)) ^ (doc.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)))
        _, first = np.unique(pair, return_index=True)
        out[:, TERMS] = 1 - np.bincount(doc[first], minlength=docs) / some
        same = np.zeros(len(h), dtype=bool)
        same[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
        out[:, TERMS + 1] = np.bincount(doc, same, docs) / some
        tail = data[ends - 1]
        marks = ~((tail >= 97) & (tail <= 122) | (tail >= 65) & (tail <= 90) | (tail >= 128))
        out[:, TERMS + 2] = np.bincount(doc, marks, docs) / some
        out[:, TERMS + 3] = np.bincount(doc, ends - starts == 1, docs) / some
    row = np.repeat(np.arange(docs), lengths + 1)
    letters = data[:size]
    total = np.maximum(lengths, 1).astype(np.float32)
    for k, kind in enumerate(((letters >= 65) & (letters <= 90), (letters >= 48) & (letters <= 57), (letters > 32) & (letters < 48))):
        out[:, TERMS + 4 + k] = np.bincount(row, kind, docs) / total
    out[:, TERMS + 7] = np.minimum(words / 200.0, 0.2) * (words > 0)
    return out


def counted(column: pa.Array, most_bytes: int = 2_000_000, most_rows: int = 512) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, term counts) of runs of texts that hold about ``most_bytes`` and ``most_rows``."""
    for first in range(0, len(column), most_rows):
        for row, data, offsets in arrays.chunks(column.slice(first, most_rows), most_bytes):
            yield first + row, np.minimum(term_counts(data, offsets), 60000)


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts[:, :TERMS]) * idf
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    x /= np.maximum(norm, 1e-9)
    return np.concatenate((x, counts[:, TERMS:] * (STYLE_WEIGHT / 20) * (norm > 0)), 1)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def nearest(cos: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k largest of each row; of equal ones at the end, those with the lowest place."""
    if k >= cos.shape[1]:
        return np.tile(np.arange(cos.shape[1]), (len(cos), 1))
    out = np.argpartition(-cos, k - 1, axis=1)[:, :k]
    last = np.take_along_axis(cos, out, 1).min(1)
    tied = np.flatnonzero((cos >= last[:, None]).sum(1) > k)
    for i in tied.tolist():
        out[i] = np.argsort(-cos[i], kind="stable")[:k]
    return out


class Voters:
    """Latent axes, and labelled vectors with their labels. ``rows`` hold the labelled texts' counts as
    (places, values); they are made dense a block at a time."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, axes: int, k: int, seed: int = 11, block: int = 256) -> None:
        self.labels, self.k = labels.astype(np.float32), k
        seen = np.zeros(TERMS)
        for at, _ in rows:
            seen[at[at < TERMS]] += 1
        self.idf = np.log((1 + len(rows)) / (1 + seen)).astype(np.float32) + np.float32(0.1)

        def blocks() -> Iterator[np.ndarray]:
            for a in range(0, len(rows), block):
                counts = np.zeros((min(block, len(rows) - a), TERMS + STYLE), np.float32)
                for i, (at, value) in enumerate(rows[a : a + block]):
                    counts[i, at] = value
                yield weighted(counts, self.idf)

        probe = np.random.default_rng(seed).standard_normal((TERMS + STYLE, min(axes + 8, max(len(rows), 1)))).astype(np.float32)
        for _ in range(4):
            probe, _ = np.linalg.qr(sum(x.T @ (x @ probe) for x in blocks()))
        _, _, right = np.linalg.svd(np.concatenate([x @ probe for x in blocks()]), full_matrices=False)
        self.axes = (probe @ right.T)[:, :axes].astype(np.float32)
        self.vectors = unit(np.concatenate([x @ self.axes for x in blocks()]))

    def score(self, counts: np.ndarray, block: int = 256) -> np.ndarray:
        z = unit(weighted(counts, self.idf) @ self.axes)
        out = np.empty(len(z))
        k, prior = min(self.k, len(self.labels)), float(self.labels.mean())
        for a in range(0, len(z), block):
            cos = z[a : a + block] @ self.vectors.T
            near = nearest(cos, k)
            weight = np.maximum(np.take_along_axis(cos, near, 1), 0).astype(float) ** 8
            total = weight.sum(1)
            out[a : a + block] = np.where(total > 1e-9, (weight * self.labels[near]).sum(1) / np.maximum(total, 1e-9), prior)
        return np.clip(out, 0, 1)


def fit(docs: DataFrame, labels: DataFrame, sample: int = 4000, axes: int = 48, k: int = 15) -> Voters | None:
    """``docs`` (doc_id, text, held_out); ``labels`` (doc_id, quality)."""
    marked = labels.where(F.col("quality").isin(0, 1)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    learn = marked.where(~tables.held_out(F.col("doc_id"), 3, 1)).orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample)

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, counts in counted(batch.column(1)):
                at = [np.flatnonzero(x) for x in counts]
                value = [np.minimum(x[i], 60000).astype("<f2").tobytes() for x, i in zip(counts, at, strict=True)]
                n = len(counts)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(row, n) for c in (0, 2, 3)), pa.array([i.astype("<u2").tobytes() for i in at], pa.binary()), pa.array(value, pa.binary())], ["doc_id", "quality", "tie", "at", "value"])

    texts = docs.join(F.broadcast(learn), "doc_id").select("doc_id", "text", "quality", F.xxhash64("text").alias("tie"))
    found = texts.mapInArrow(tables.lean(terms), "doc_id long, quality int, tie long, at binary, value binary")
    rows = found.orderBy(F.xxhash64("doc_id"), "doc_id", "tie", "quality").limit(sample).collect()
    if not rows:
        return None
    counts = [(np.frombuffer(r["at"], "<u2").astype(np.int64), np.frombuffer(r["value"], "<f2").astype(np.float32)) for r in rows]
    return Voters(counts, np.array([r["quality"] for r in rows]), axes, k)


def score_documents(docs: DataFrame, labels: DataFrame, **options: int) -> DataFrame:
    """doc_id, held_out, score, predicted of each document; rows whose crc32(doc_id as text) leaves 1
    by 3 are held out and never learnt from."""
    rows = tables.texts(docs).withColumn("held_out", tables.held_out(F.col("doc_id"), 3, 1))
    shared = docs.sparkSession.sparkContext.broadcast(fit(rows, labels, **options))

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voters = shared.value
        for batch in batches:
            for row, counts in counted(batch.column(1)):
                n = len(counts)
                score = np.full(n, 0.5) if voters is None else voters.score(counts)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, n), batch.column(2).slice(row, n), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return rows.select("doc_id", "text", "held_out").mapInArrow(tables.lean(vote), "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **options: int) -> DataFrame:
    """The rows of ``docs``, all columns, that score ``threshold`` or more."""
    spark = docs.sparkSession
    rows = tables.texts(docs).withColumn("held_out", tables.held_out(F.col("doc_id"), 3, 1))
    shared = spark.sparkContext.broadcast(fit(rows, labels, **options))
    place = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voters = shared.value
        for batch in batches:
            if voters is None:
                yield batch
                continue
            for row, counts in counted(batch.column(place)):
                score = voters.score(counts)
                part = pa.Table.from_batches([batch.slice(row, len(score))]).filter(pa.array(score >= threshold))
                yield from part.to_batches()

    return docs.mapInArrow(tables.lean(keep), docs.schema)
