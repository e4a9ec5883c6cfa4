"""Benchmark passages in documents, found by embedded windows and confirmed by edit distance.

The CGK random walk reads a window's words with a pointer that advances or stays by a random bit of
(step, word); what it reads step by step is a sequence in which a small edit distance becomes a small
Hamming distance. Each repetition has its own walk and samples ``bits`` of its steps; windows that
agree on all sampled steps meet. A document's windows begin at every word and are as long as the
items; an item is entered at every word at which ``steps`` steps may still be read, so that edits
elsewhere in the item don't hide it. A sampled step whose prefix no item has ends the walk of that
window, which leaves results as they are. ``repetitions`` is set so that an item with one word in
five edited still meets in some entry with a recall above 0.95, one in ten with 0.99 (tests measure
it). Walks of items below ``SHORT`` words would run past the item's end into words that are not its
own, so these items are cut into one piece more than they may have edits: a passage within the edits
holds at least one piece as it is, and looking up all pieces misses none. What meets is confirmed: the
least number of word edits between the item and any passage of the document there must be at most a
fifth of the item's words.

Words are runs of other than ASCII white space, A-Z in lower case. The items are broadcast; their
number and size are checked against ``most_items`` and ``most_words``, beyond which they are taken in
blocks of that size, each against all documents.

Nulls: null or wordless items and texts match nothing; null item ids and document ids are kept as
they are. Repeated rows each match. Extra columns are ignored by ``matches`` and kept by
``drop_contaminated``. Without documents or items there are no matches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays, tables

#: Items of fewer words are found by their pieces, others by walks.
SHORT = 24


def runs(flat: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """Hashes of the 1, 2, .. ``most`` words that begin at each place with so many words after it."""
    key = arrays.mix(flat)
    for size in range(1, most + 1):
        if size > 1:
            key = arrays.mix(key[:-1] * np.uint64(0x9FB21C651E98DF25) + flat[size - 1 :])
        yield key
        if len(key) <= 1:
            return


class Pieces:
    """Items of ``which`` as pieces, one more than the edits an item may have; by size of the piece."""

    def __init__(self, words: list[np.ndarray], which: list[int], edits: float) -> None:
        self.words, self.edits = words, edits
        by: dict[int, list[tuple[int, int, int]]] = {}
        for i in which:
            n = len(words[i])
            parts = min(n, int(n * edits + 1e-9) + 1)
            cuts = [n * k // parts for k in range(parts + 1)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                *_, key = runs(words[i][a:b], b - a)
                by.setdefault(b - a, []).append((int(key[0]), i, a))
        self.sizes = {}
        for size, rows in by.items():
            rows.sort()
            keys, first = np.unique(np.array([r[0] for r in rows], np.uint64), return_index=True)
            self.sizes[size] = arrays.HashIndex(keys), np.append(first, len(rows)), np.array([r[1] for r in rows]), np.array([r[2] for r in rows])

    def meet(self, flat: np.ndarray, doc: np.ndarray, bounds: np.ndarray, most: int = 100_000) -> np.ndarray:
        """Rows (document, item, where the item would begin, were there no edits before) that may be
        within the edits: all but so many of the item's words are around."""
        out = [np.zeros((0, 3), np.int64)]
        for size, key in enumerate(runs(flat, max(self.sizes, default=0)), 1):
            if size not in self.sizes:
                continue
            index, cuts, owner, place = self.sizes[size]
            found = index.find(key)
            at = np.flatnonzero(found >= 0)
            at = at[at + size <= bounds[doc[at] + 1]]
            n = cuts[found[at] + 1] - cuts[found[at]]
            block = np.cumsum(n) // most
            for b in np.unique(block):
                some = block == b
                row = arrays.spread(cuts[found[at[some]]], n[some])
                here = np.repeat(at[some], n[some])
                out.append(self.near(flat, bounds, doc[here], owner[row], here - place[row]))
        return np.concatenate(out)

    def near(self, flat: np.ndarray, bounds: np.ndarray, doc: np.ndarray, item: np.ndarray, begin: np.ndarray) -> np.ndarray:
        size = np.array([len(w) for w in self.words])[item]
        keep = np.zeros(len(item), bool)
        for n in np.unique(size).tolist():
            most = int(n * self.edits + 1e-9)
            rows = np.flatnonzero(size == n)
            for part in np.array_split(rows, len(rows) // 20_000 + 1):
                words = np.stack([self.words[i] for i in item[part].tolist()]) if len(part) else np.zeros((0, n), np.uint64)
                there = np.zeros(words.shape, bool)
                for step in range(-most, n + most):
                    spot = begin[part] + step
                    inside = (spot >= bounds[doc[part]]) & (spot < bounds[doc[part] + 1])
                    there |= (words == flat[np.where(inside, spot, 0)][:, None]) & inside[:, None]
                keep[part] = n - there.sum(axis=1) <= most
        return np.stack((doc[keep], item[keep], begin[keep]), 1)


class Items:
    """Items as word hashes, and for each repetition the keys their windows have after each sampled
    step; short ones as pieces."""

    def __init__(self, ids: list[int | None], texts: list[str], repetitions: int, bits: int, steps: int, seed: int, edits: float = 0.2) -> None:
        self.ids, self.words = [], []
        for i, text in zip(ids, texts, strict=True):
            for _, data, offsets in arrays.chunks(pa.array([text]), 1 << 30, lower=True):
                h = arrays.hash_segments(data, *arrays.word_bounds(data, int(offsets[-1])))
            if len(h):
                self.ids.append(i)
                self.words.append(h)
        self.pieces = Pieces(self.words, [i for i, w in enumerate(self.words) if len(w) < SHORT], edits)
        rng = np.random.default_rng(seed)
        self.steps, self.salts = steps, [np.uint64(x) for x in rng.integers(1, 2**62, repetitions)]
        # The first step reads the first word; the others are spread over the walk at random.
        self.sampled = [np.unique(np.concatenate(([0], rng.choice(np.arange(1, steps), bits - 1, replace=False)))) for _ in range(repetitions)]
        owner = np.repeat(np.arange(len(self.words)), [len(w) for w in self.words])
        place = np.concatenate([np.arange(len(w)) for w in self.words]) if self.words else np.zeros(0, int)
        left = np.concatenate([len(w) - np.arange(len(w)) for w in self.words]) if self.words else np.zeros(0, int)
        flat = np.concatenate([np.append(w, np.zeros(1, np.uint64)) for w in self.words]) if self.words else np.zeros(1, np.uint64)
        base = np.cumsum([0, *[len(w) + 1 for w in self.words]])[:-1]
        whole = np.array([len(w) for w in self.words])[owner] if len(owner) else np.zeros(0, int)
        enter = (whole >= SHORT) & (left >= np.minimum(steps // 2 + 2, whole))
        self.owner, self.place = owner[enter], place[enter]
        start = base[self.owner] + self.place if len(self.owner) else np.zeros(0, int)
        stop = base[self.owner] + np.array([len(w) for w in self.words])[self.owner] if len(self.owner) else start
        self.levels = []
        for r in range(repetitions):
            keys = list(self.walk(r, flat, start, stop))
            tables_of = []
            for key in keys[:-1]:
                tables_of.append(arrays.HashIndex(np.unique(key)))
            last = np.unique(keys[-1]) if len(start) else np.zeros(0, np.uint64)
            order = np.argsort(keys[-1], kind="stable") if len(start) else np.zeros(0, int)
            cuts = np.append(np.searchsorted(keys[-1][order], last), len(order)) if len(start) else np.zeros(1, int)
            self.levels.append((tables_of, arrays.HashIndex(last), cuts, order))

    def walk(self, r: int, flat: np.ndarray, start: np.ndarray, stop: np.ndarray) -> Iterator[np.ndarray]:
        """Keys of windows [start, stop) of ``flat`` after each sampled step; send() a selection of
        windows to go on with."""
        at, key = start.copy(), np.zeros(len(start), np.uint64)
        coins = arrays.mix(flat ^ self.salts[r])  # bit j of a word's coin is the random bit of (step j, word)
        marks = set(self.sampled[r].tolist())
        for j in range(int(self.sampled[r][-1]) + 1):
            if j in marks:
                word = np.where(at < stop, flat[np.minimum(at, len(flat) - 1)], np.uint64(0))
                key = arrays.mix(key ^ (word + np.uint64(j + 1)))
                keep = yield key
                if keep is not None:
                    at, key, stop = at[keep], key[keep], stop[keep]
                    yield key
            at = at + ((coins[np.minimum(at, len(flat) - 1)] >> np.uint64(j)) & np.uint64(1)).astype(np.int64)

    def meet(self, flat: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window start, entry) of all windows that meet an item's entry in some repetition."""
        starts, entries = [], []
        if not len(self.owner):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        for r, (prefixes, final, cuts, order) in enumerate(self.levels):
            alive = np.arange(len(flat))
            walk = self.walk(r, flat, alive, stop)
            key = next(walk)
            for k in range(len(prefixes)):
                keep = np.flatnonzero(prefixes[k].find(key) >= 0)
                alive = alive[keep]
                walk.send(keep)
                if not len(alive):
                    break
                key = next(walk)
            else:
                hit = final.find(key)
                got = np.flatnonzero(hit >= 0)
                n = cuts[hit[got] + 1] - cuts[hit[got]]
                starts.append(np.repeat(alive[got], n))
                entries.append(order[arrays.spread(cuts[hit[got]], n)])
        if not starts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(starts), np.concatenate(entries)


def least_edits(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """(edits, start, end) of the passage of ``text`` nearest to ``item`` in word edits; the earliest
    end, then the longest passage, among equals."""
    n = len(text)
    cost, begin = np.zeros(n + 1, np.int64), np.arange(n + 1)
    spots = np.arange(n + 1)
    for w in item:
        swap = cost[:-1] + (text != w)
        drop = cost + 1
        new, new_begin = drop.copy(), begin.copy()
        better = (swap < new[1:]) | ((swap == new[1:]) & (begin[:-1] < new_begin[1:]))
        new[1:][better], new_begin[1:][better] = swap[better], begin[:-1][better]
        # Words of the text that the item lacks: a running minimum of cost less place.
        packed = (new - spots) * (n + 2) + new_begin
        packed = np.minimum.accumulate(packed)
        cost, begin = packed // (n + 2) + spots, packed % (n + 2)
    end = int(np.argmin(cost))
    return int(cost[end]), int(begin[end]), end


def matches(docs: DataFrame, items: DataFrame, edits: float = 0.2, repetitions: int = 6, bits: int = 8, steps: int = 20, seed: int = 5, most_items: int = 20_000, most_words: int = 2_000_000) -> DataFrame:
    """doc_id, item_id, edits, item_words, start, n_words: the nearest passage for each document and
    item that are within ``edits`` of the item's words; ``start`` counts words."""
    spark = docs.sparkSession
    wanted = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    size = wanted.agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")).first()
    blocks = max(1, -(-size["n"] // most_items), -(-(size["chars"] or 0) // (6 * most_words)))
    found = None
    for block in range(blocks):
        part = wanted if blocks == 1 else wanted.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        rows = sorted(((r["item_id"], r["text"]) for r in part.collect()), key=lambda r: (r[0] is not None, r))
        shared = spark.sparkContext.broadcast(Items([r[0] for r in rows], [r[1] for r in rows], repetitions, bits, steps, seed, edits))
        out = _against(docs, shared, edits)
        found = out if found is None else found.unionByName(out)
    return found


def _against(docs: DataFrame, shared, edits: float) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        for batch in batches:
            for row, data, offsets in arrays.chunks(batch.column(1), 2_000_000, lower=True):
                starts, ends = arrays.word_bounds(data, int(offsets[-1]))
                if not len(starts) or not items.words:
                    continue
                flat = arrays.hash_segments(data, starts, ends)
                bounds = np.searchsorted(starts, offsets)
                doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
                at, entry = items.meet(flat, bounds[1:][doc])
                item = items.owner[entry]
                begin = at - items.place[entry]  # where the item would begin, were there no edits before
                group = np.unique(np.concatenate((np.stack((doc[at], item, begin), 1), items.pieces.meet(flat, doc, bounds))), axis=0)
                # Of places that hold an item as it is, the first of a document will do.
                exact = np.array([int(len(w) * edits + 1e-9) == 0 for w in items.words])[group[:, 1]]
                group = group[~(exact & np.append(False, (group[1:, :2] == group[:-1, :2]).all(axis=1))[: len(group)])]
                best: dict[tuple[int, int], tuple[int, int, int]] = {}
                for d, i, b in group.tolist():
                    words = items.words[i]
                    most = int(len(words) * edits + 1e-9)
                    lo, hi = max(bounds[d], b - most), min(bounds[d + 1], b + len(words) + most)
                    have = best.get((d, i))
                    if have and have[0] == 0:
                        continue
                    cost, s, e = least_edits(words, flat[lo:hi])
                    new = (cost, int(lo - bounds[d]) + s, e - s)
                    if cost <= most and (have is None or new < have):
                        best[d, i] = new
                if best:
                    keys = list(best)
                    ids = batch.column(0).take(pa.array([row + d for d, _ in keys]))
                    values = np.array([best[k] for k in keys])
                    yield pa.RecordBatch.from_arrays([ids, pa.array([items.ids[i] for _, i in keys], pa.int64()), pa.array(values[:, 0]), pa.array([len(items.words[i]) for _, i in keys], pa.int64()), pa.array(values[:, 1]), pa.array(values[:, 2])], ["doc_id", "item_id", "edits", "item_words", "start", "n_words"])

    return tables.texts(docs).mapInArrow(tables.lean(work), "doc_id long, item_id long, edits long, item_words long, start long, n_words long")


def drop_contaminated(docs: DataFrame, items: DataFrame, **options: float) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no item. Rows are matched by id; rows without an
    id by their text."""
    key = F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text"))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), key.alias("key"))
    found = matches(docs.select(key.alias("doc_id"), "text"), items, **options)
    hit = tables.written(found.select("doc_id").distinct(), "leaks")
    return whole.join(hit, F.col("key") == F.col("doc_id"), "left_anti").select("row.*")
