"""A gated recurrent language model, trained and applied where the texts are.

Counts of all training tokens come first: they give the base (unigram) score, the model's word list
and the shares of rarer words. The model's symbols are the most frequent words, the end of a text,
and 32 groups of rarer words by their last two bytes; the output softmax is factored into classes of
symbols and symbols within a class. A rarer word has its group's probability times its smoothed share
of that group, so probabilities sum to one over all words. Every task trains on its own training
texts from a common start, by truncated backpropagation over windows with the state carried through
the whole text; the weights are averaged over the tasks by tokens, so they depend a little on how rows
lie in tasks, as any parallel training does. Scoring carries the state through whole texts.

Rare words' counts are joined by word hash, not broadcast: what is broadcast is the ``head`` most
frequent words and the model, both of fixed size.

Nulls: null text is empty (its end token alone). A null doc_id is in no held-out tenth unless the
crc32 of the empty text says so. Repeated rows are scored each. Extra columns are ignored. With no
training texts at all every word is unknown and the model is its random start. An empty table gives
no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays, tables

GROUPS = 32
WINDOW = 16
END_HASH = np.uint64(0x5EED0E4D00000001)
BLOCKS = 64


def symbols(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word hash, group by the last two bytes)."""
    last = data[ends - 1].astype(np.int64)
    before = np.where(ends - starts > 1, data[np.maximum(ends - 2, 0)], 0).astype(np.int64)
    return arrays.hash_segments(data, starts, ends), ((last * 131 + before * 31) % 1009 % GROUPS).astype(np.int32)


class Lexicon:
    """The words with the highest counts, and the model's symbols. Small enough to broadcast."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, groups: np.ndarray, total: int, distinct: int, texts: int, group_count: np.ndarray, group_words: np.ndarray, classes: int, width: int) -> None:
        self.hashes, self.counts = hashes, counts
        self.total, self.distinct, self.texts = total, distinct, texts
        self.listed = min(len(hashes), classes * width - GROUPS - 1)
        in_list = np.bincount(groups[: self.listed], counts[: self.listed], GROUPS)
        words_in_list = np.bincount(groups[: self.listed], minlength=GROUPS)
        self.group_size = np.log10(group_count - in_list + 0.1 * (group_words - words_in_list + 1))
        weight = np.concatenate((counts[: self.listed].astype(float), group_count - in_list, [texts]))
        order = np.argsort(-weight, kind="stable")
        self.symbol = np.empty(len(order), dtype=np.int32)
        self.symbol[order] = np.arange(len(order))
        self.weight = weight[order]
        self.end = int(self.symbol[-1])
        self.index = None

    def read(self, hashes: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position in the head or -1, symbol) of each word."""
        if self.index is None:
            self.index = arrays.HashIndex(self.hashes)
        at = self.index.find(hashes)
        return at, np.where((at >= 0) & (at < self.listed), self.symbol[np.clip(at, 0, max(self.listed - 1, 0))], self.symbol[self.listed + groups])


def word_counts(docs: DataFrame) -> DataFrame:
    """hash, group, c over the training texts (column ``held_out`` false), ends not included."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, offsets in arrays.chunks(batch.column(0), 4_000_000, lower=True):
                h, group = symbols(data, *arrays.word_bounds(data, int(offsets[-1])))
                found, first, n = np.unique(h, return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(group[first]), pa.array(n)], ["hash", "grp", "c"])

    parts = docs.where(~F.col("held_out")).select("text").mapInArrow(count, "hash long, grp int, c long")
    return parts.groupBy("hash").agg(F.min("grp").alias("grp"), F.sum("c").alias("c"))


def lexicon(counts: DataFrame, texts: int, classes: int, width: int, head: int) -> Lexicon:
    per_group = counts.groupBy("grp").agg(F.sum("c").alias("c"), F.count("*").alias("v")).toPandas()
    # Counts by steps of a twelfth of their binary logarithm: the lowest step that still fits the head.
    step = F.floor(F.log2("c") * 12)
    steps = sorted(((r["s"], r["n"]) for r in counts.groupBy(step.alias("s")).agg(F.count("*").alias("n")).collect()), reverse=True)
    upto, least = 0, 1 << 40
    for s, n in steps:
        if upto + n > head:
            break
        upto, least = upto + n, s
    top = counts.where(step >= least).toPandas().sort_values(["c", "hash"], ascending=[False, True])
    count, words = np.zeros(GROUPS), np.zeros(GROUPS)
    count[per_group["grp"]], words[per_group["grp"]] = per_group["c"], per_group["v"]
    return Lexicon(top["hash"].to_numpy(np.int64).view(np.uint64), top["c"].to_numpy(np.int64), top["grp"].to_numpy(np.int32), int(count.sum()) + texts, int(words.sum()) + (texts > 0), texts, count, words, classes, width)


class Model:
    """GRU with a class-factored softmax. ``p`` holds the weights by name."""

    def __init__(self, p: dict[str, np.ndarray]) -> None:
        self.p = p
        self.hidden = p["U"].shape[0]
        self.classes, self.width = p["wb"].shape

    @classmethod
    def fresh(cls, classes: int, width: int, hidden: int, weight: np.ndarray, seed: int = 7) -> Model:
        rng = np.random.default_rng(seed)
        normal = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(np.float32)
        share = np.full(classes * width, 1e-9)
        share[: len(weight)] = np.maximum(weight, 0.1)
        share = share.reshape(classes, width)
        return cls({
            "X": normal(classes * width, 3 * hidden), "U": normal(hidden, 3 * hidden), "b": np.zeros(3 * hidden, np.float32),
            "C": normal(hidden, classes), "cb": np.log(share.sum(1) / share.sum()).astype(np.float32),
            "W": normal(classes, hidden, width), "wb": np.log(share / share.sum(1, keepdims=True)).astype(np.float32),
        })

    def flat(self) -> np.ndarray:
        return np.concatenate([self.p[k].ravel() for k in sorted(self.p)])

    def with_flat(self, flat: np.ndarray) -> Model:
        out, at = {}, 0
        for k in sorted(self.p):
            n = self.p[k].size
            out[k] = flat[at : at + n].reshape(self.p[k].shape).astype(np.float32)
            at += n
        return Model(out)

    def run(self, h: np.ndarray, inputs: np.ndarray, sizes: list[int], keep: bool):
        """States after each step. Rows are ordered by length, so step t works on the first sizes[t]."""
        H, U = self.hidden, self.p["U"]
        gates = self.p["X"][inputs] + self.p["b"]
        out, saved = np.zeros((inputs.shape[0], inputs.shape[1], H), np.float32), []
        h = h.copy()
        for t, n in enumerate(sizes):
            prev = h[:n]
            g = gates[t, :n]
            zr = prev @ U[:, : 2 * H]
            zr += g[:, : 2 * H]
            zr *= 0.5
            np.tanh(zr, out=zr)
            zr *= 0.5
            zr += 0.5
            z, r = zr[:, :H], zr[:, H:]
            rh = r * prev
            c = rh @ U[:, 2 * H :]
            c += g[:, 2 * H :]
            np.tanh(c, out=c)
            new = c + z * (prev - c)
            if keep:
                saved.append((prev.copy(), z, r, rh, c))
            h[:n] = new
            out[t, :n] = new
        return h, out, saved

    def losses(self, states: np.ndarray, targets: np.ndarray, grad: dict | None = None):
        """Natural-log probability of each target; fills ``grad`` and returns the states' gradient too."""
        cls, sub = targets // self.width, targets % self.width
        logit = states @ self.p["C"]
        logit += self.p["cb"]
        logit -= logit.max(1, keepdims=True)
        at = np.arange(len(targets))
        own = logit[at, cls]
        np.exp(logit, out=logit)
        total = logit.sum(1)
        logp = own - np.log(total)
        order = np.argsort(cls, kind="stable")
        cuts = np.searchsorted(cls[order], np.arange(self.classes + 1))
        inner = np.empty(len(targets), np.float32)
        dstates = None
        if grad is not None:
            logit /= total[:, None]
            logit[at, cls] -= 1
            grad["C"], grad["cb"] = states.T @ logit, logit.sum(0)
            dstates = logit @ self.p["C"].T
            grad["W"], grad["wb"] = np.zeros_like(self.p["W"]), np.zeros_like(self.p["wb"])
        for k in np.flatnonzero(np.diff(cuts)):
            rows = order[cuts[k] : cuts[k + 1]]
            s = states[rows]
            x = s @ self.p["W"][k]
            x += self.p["wb"][k]
            x -= x.max(1, keepdims=True)
            i = np.arange(len(rows))
            mine = x[i, sub[rows]]
            np.exp(x, out=x)
            norm = x.sum(1)
            inner[rows] = mine - np.log(norm)
            if grad is not None:
                x /= norm[:, None]
                x[i, sub[rows]] -= 1
                grad["W"][k], grad["wb"][k] = s.T @ x, x.sum(0)
                dstates[rows] += x @ self.p["W"][k].T
        return logp + inner, dstates

    def backward(self, inputs, sizes, saved, dout, grad) -> None:
        """Backpropagation through the window only; the state before it counts as given."""
        H, U = self.hidden, self.p["U"]
        dU, dh = np.zeros_like(U), np.zeros((inputs.shape[1], H), np.float32)
        dg = np.zeros((inputs.shape[0], inputs.shape[1], 3 * H), np.float32)
        for t in range(len(sizes) - 1, -1, -1):
            n = sizes[t]
            prev, z, r, rh, c = saved[t]
            d = dh[:n] + dout[t, :n]
            dc = d * (1 - z) * (1 - c * c)
            drh = dc @ U[:, 2 * H :].T
            g = dg[t, :n]
            g[:, 2 * H :] = dc
            g[:, :H] = d * (prev - c) * z * (1 - z)
            g[:, H : 2 * H] = drh * prev * r * (1 - r)
            dh[:n] = d * z + drh * r + g[:, : 2 * H] @ U[:, : 2 * H].T
            dU[:, : 2 * H] += prev.T @ g[:, : 2 * H]
            dU[:, 2 * H :] += rh.T @ dc
        flat, sym = dg.reshape(-1, 3 * H), inputs.ravel()
        order = np.argsort(sym, kind="stable")
        first = np.flatnonzero(np.diff(sym[order], prepend=-1))
        dX = np.zeros_like(self.p["X"])
        dX[sym[order][first]] = np.add.reduceat(flat[order], first, axis=0)
        grad["X"], grad["U"], grad["b"] = dX, dU, flat.sum(0)


class Adam:
    def __init__(self, model: Model, rate: float) -> None:
        self.model, self.rate, self.t = model, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in model.p.items()}
        self.v = {k: np.zeros_like(v) for k, v in model.p.items()}

    def step(self, grad: dict[str, np.ndarray], scale: float, share: float = 1.0) -> None:
        """``share`` is how large a step to take, of a full one."""
        self.t += 1
        fix = share * self.rate * np.sqrt(1 - 0.99**self.t) / (1 - 0.9**self.t)
        for k, g in grad.items():
            g = g * np.float32(scale)
            self.m[k] += np.float32(0.1) * (g - self.m[k])
            self.v[k] += np.float32(0.01) * (g * g - self.v[k])
            self.model.p[k] -= np.float32(fix) * self.m[k] / (np.sqrt(self.v[k]) + np.float32(1e-6))


def padded(flat: np.ndarray, sizes: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of symbols, ordered by falling length, as (inputs, targets) [step, row]: each row's first
    input is the symbol ``before`` it."""
    steps, rows = int(sizes.max()), len(sizes)
    targets = np.zeros((steps, rows), dtype=np.int32)
    targets[arrays.spread(np.zeros(rows, np.int64), sizes), np.repeat(np.arange(rows), sizes)] = flat
    return np.concatenate((before[None, :].astype(np.int32), targets[:-1])), targets


def train(model: Model, chunks: Iterator[tuple[np.ndarray, np.ndarray]], end: int, rate: float, cut: int = 2048, rows_at_once: int = 640) -> int:
    """One pass over chunks of (flat symbols, sizes) by truncated backpropagation over windows. Texts
    are read ``cut`` symbols at a time; those that go on wait until there are enough of them, and go
    on with the state and the symbol they stopped at. The end is a target where the text ends."""
    adam, seen = Adam(model, rate), 0
    waiting: list[tuple[np.ndarray, int, np.ndarray]] = []  # symbols with the end, place, state there

    def learn(texts: list[tuple[np.ndarray, int, np.ndarray]]) -> None:
        nonlocal seen
        texts = sorted(texts, key=lambda x: -min(len(x[0]) - x[1], cut))
        n = np.array([min(len(x) - a, cut) for x, a, _ in texts])
        before = np.array([x[a - 1] if a else end for x, a, _ in texts], np.int32)
        inputs, targets = padded(np.concatenate([x[a : a + cut] for x, a, _ in texts]), n, before)
        h = np.stack([state for _, _, state in texts])
        live = len(n) - np.searchsorted(n[::-1], np.arange(inputs.shape[0]), "right")
        for t in range(0, inputs.shape[0], WINDOW):
            size = live[t : t + WINDOW].tolist()
            x, y = inputs[t : t + len(size), : size[0]], targets[t : t + len(size), : size[0]]
            h, out, saved = model.run(h[: size[0]], x, size, True)
            on = np.arange(size[0])[None, :] < np.array(size)[:, None]
            grad: dict[str, np.ndarray] = {}
            _, d = model.losses(out[on], y[on], grad)
            dout = np.zeros_like(out)
            dout[on] = d
            model.backward(x, size, saved, dout, grad)
            count = int(on.sum())
            adam.step(grad, 1 / count, min(1.0, count / 4096))  # a few rows don't move the net far
            seen += count
        # Those that go on filled all steps, so they stand first.
        waiting.extend((x, a + cut, h[i].copy()) for i, (x, a, _) in enumerate(texts) if len(x) > a + cut)

    empty = np.zeros(model.hidden, np.float32)
    for flat, sizes in chunks:
        ends = np.cumsum(sizes)
        order = np.argsort(-sizes, kind="stable").tolist()
        for k in range(0, len(order), rows_at_once):
            learn([(np.append(flat[ends[i] - sizes[i] : ends[i]], np.int32(end)), 0, empty) for i in order[k : k + rows_at_once]])
        while len(waiting) >= rows_at_once:
            some, waiting[:] = waiting[:rows_at_once], waiting[rows_at_once:]
            learn(some)
    while waiting:
        some, waiting[:] = waiting[:rows_at_once], waiting[rows_at_once:]
        learn(some)
    return seen


def log_likelihood(model: Model, flat: np.ndarray, sizes: np.ndarray, end: int, rows_at_once: int = 2048) -> np.ndarray:
    """log10 probability of each row of symbols and its end; the state goes through the whole row."""
    out = np.zeros(len(sizes))
    order = np.argsort(-sizes, kind="stable")
    ends = np.cumsum(sizes)
    for k in range(0, len(order), rows_at_once):
        rows = order[k : k + rows_at_once]
        n, begin = sizes[rows], (ends - sizes)[rows]
        h, total = np.zeros((len(rows), model.hidden), np.float32), np.zeros(len(rows))
        for t in range(0, int(n[0]) + 1, WINDOW):
            steps = np.arange(t, min(t + WINDOW, int(n[0]) + 1))
            size = [int(np.searchsorted(-n, -s, "right")) for s in steps]
            live, m = size[0], n[: size[0], None]
            spot = begin[:live, None] + steps[None, :]
            y = np.where(steps[None, :] < m, flat[np.minimum(spot, max(len(flat) - 1, 0))] if len(flat) else end, end).T
            x = np.where((steps[None, :] > 0) & (steps[None, :] <= m), flat[np.clip(spot - 1, 0, max(len(flat) - 1, 0))] if len(flat) else end, end).T
            h, states, _ = model.run(h[:live], x, size, False)
            on = np.arange(live)[None, :] < np.array(size)[:, None]
            logp, _ = model.losses(states[on], y[on])
            each = np.zeros(on.shape)
            each[on] = logp
            total[:live] += each.sum(0)
        out[rows] = total / np.log(10)
    return out


def averaged(parts: DataFrame) -> np.ndarray:
    """Mean of the tasks' weights by tokens, block by block, in two levels so that no group grows
    with more than the square root of the tasks."""

    def mean(pdf: pd.DataFrame) -> pd.DataFrame:
        w = pdf["tokens"].to_numpy(float)
        total = w.sum()
        value = reduce(np.add, (np.frombuffer(v, np.float32) * (x / total) for v, x in zip(pdf["v"], w, strict=True)))
        return pd.DataFrame({"block": [pdf["block"].iloc[0]], "tokens": [total], "v": [value.astype(np.float32).tobytes()]})

    schema = "block int, tokens double, v binary"
    first = parts.groupBy("block", F.pmod("task", F.lit(64))).applyInPandas(mean, schema)
    rows = sorted((r["block"], bytes(r["v"])) for r in first.groupBy("block").applyInPandas(mean, schema).collect())
    return np.concatenate([np.frombuffer(v, np.float32) for _, v in rows]) if rows else np.zeros(0, np.float32)


def trained(docs: DataFrame, lex: Lexicon, classes: int, width: int, hidden: int, warm_texts: int, rate: float) -> Model:
    """The model after a warm-up on about ``warm_texts`` texts in one task and one pass over all training
    texts in all tasks."""
    sc = docs.sparkSession.sparkContext

    def fit(start: Model, shared_lex, rate: float, source: DataFrame) -> np.ndarray:
        shared = sc.broadcast(start)

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lexi, model = shared_lex.value, Model({k: v.copy() for k, v in shared.value.p.items()})

            def chunks() -> Iterator[tuple[np.ndarray, np.ndarray]]:
                for batch in batches:
                    for _, data, offsets in arrays.chunks(batch.column(0), 4_000_000, lower=True):
                        starts, ends = arrays.word_bounds(data, int(offsets[-1]))
                        _, symbol = lexi.read(*symbols(data, starts, ends))
                        yield symbol, np.diff(np.searchsorted(starts, offsets))

            seen = train(model, chunks(), lexi.end, rate)
            if seen:
                blocks = np.array_split(model.flat(), BLOCKS)
                task = TaskContext.get().partitionId()
                yield pa.RecordBatch.from_pydict({"task": [task] * BLOCKS, "block": list(range(BLOCKS)), "tokens": [float(seen)] * BLOCKS, "v": [b.tobytes() for b in blocks]}, schema=pa.schema([("task", pa.int32()), ("block", pa.int32()), ("tokens", pa.float64()), ("v", pa.binary())]))

        return averaged(source.mapInArrow(work, "task int, block int, tokens double, v binary"))

    model = Model.fresh(classes, width, hidden, lex.weight)
    shared_lex = sc.broadcast(lex)
    learn = docs.where(~F.col("held_out")).select("text")
    # About warm_texts texts by a hash, so that one task reads as little whatever the number of texts.
    share = min(1.0, warm_texts / max(lex.texts, 1))
    some = docs.where(~F.col("held_out") & (F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000)) < F.lit(int(share * 1_000_000) + 1)))
    warm = fit(model, shared_lex, rate * 2, some.select("text").limit(2 * warm_texts).coalesce(1))
    if len(warm):
        model = model.with_flat(warm)
        model = model.with_flat(fit(model, shared_lex, rate, learn))
    return model


def score(docs: DataFrame, classes: int = 32, width: int = 32, hidden: int = 16, head: int = 1 << 18, warm_texts: int = 1500, rate: float = 0.004, park: int = 2048) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row of ``docs``
    (doc_id, text, held_out), learning from rows with ``held_out`` false."""
    spark = docs.sparkSession
    counts = tables.written(word_counts(docs), "lm-counts")
    n_texts = docs.where(~F.col("held_out")).count()
    lex = lexicon(counts, n_texts, classes, width, head)
    model = trained(docs, lex, classes, width, hidden, warm_texts, rate)
    shared = spark.sparkContext.broadcast((lex, model))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexi, net = shared.value
        task, number = TaskContext.get().partitionId() << 33, 0
        log_head = np.log10(lexi.counts + 0.1)
        end_base = np.log10(lexi.texts + 0.1)
        waiting: list[tuple] = []

        def finish(keys, flat, sizes, base) -> pa.RecordBatch:
            cols = [*keys, *base, pa.array(log_likelihood(net, flat, sizes, lexi.end))]
            return pa.RecordBatch.from_arrays(cols, ["uid", "doc_id", "held_out", "n_tokens", "n_known", "head_sum", "rest_sum", "tail", "tf", "tail_group", "net"])

        def merged() -> pa.RecordBatch:
            keys = [pa.concat_arrays([w[0][i] for w in waiting]) for i in range(3)]
            base = [pa.concat_arrays([w[3][i] for w in waiting]) for i in range(7)]
            flat, sizes = np.concatenate([w[1] for w in waiting]), np.concatenate([w[2] for w in waiting])
            waiting.clear()
            return finish(keys, flat, sizes, base)

        for batch in batches:
            for row, data, offsets in arrays.chunks(batch.column(1), 4_000_000, lower=True):
                starts, ends = arrays.word_bounds(data, int(offsets[-1]))
                h, group = symbols(data, starts, ends)
                at, symbol = lexi.read(h, group)
                bounds = np.searchsorted(starts, offsets)
                sizes = np.diff(bounds)
                doc = np.repeat(np.arange(len(sizes)), sizes)
                known = at >= 0
                listed = known & (at < lexi.listed)
                value = np.where(known, log_head[np.maximum(at, 0)] if len(log_head) else 0.0, 0.0)
                head_sum = np.bincount(doc, value, len(sizes)) + end_base
                rest = np.where(listed, 0.0, value - lexi.group_size[group])
                rest_sum = np.bincount(doc, rest, len(sizes))
                tail = np.flatnonzero(~known)
                order = tail[np.lexsort((h[tail], doc[tail]))]
                new = np.flatnonzero((np.diff(doc[order], prepend=-1) != 0) | (np.diff(h[order].view(np.int64), prepend=0) != 0)) if len(order) else np.zeros(0, np.int64)
                if len(order) and (not len(new) or new[0] != 0):
                    new = np.concatenate(([0], new))
                tf = np.diff(np.append(new, len(order)))
                lists = pa.array(np.concatenate(([0], np.cumsum(np.bincount(doc[order[new]], minlength=len(sizes))))).astype(np.int32))
                keys = [pa.array(task + number + np.arange(len(sizes))), batch.column(0).slice(row, len(sizes)), batch.column(2).slice(row, len(sizes))]
                number += len(sizes)
                base = [
                    pa.array(sizes + 1), pa.array(np.bincount(doc, known, len(sizes)).astype(np.int64) + (lexi.texts > 0)), pa.array(head_sum), pa.array(rest_sum),
                    pa.ListArray.from_arrays(lists, pa.array(h[order[new]].view(np.int64))), pa.ListArray.from_arrays(lists, pa.array(tf.astype(np.int32))), pa.array(np.zeros(len(sizes), np.int32)),
                ]
                short, long = np.flatnonzero(sizes <= park), np.flatnonzero(sizes > park)
                begin = np.cumsum(sizes) - sizes
                for rows in (short, long):
                    if len(rows):
                        take = pa.array(rows)
                        part = ([k.take(take) for k in keys], symbol[arrays.spread(begin[rows], sizes[rows])], sizes[rows], [b.take(take) for b in base])
                        if rows is short:
                            yield finish(*part)
                        else:
                            waiting.append(part)
                if sum(len(w[1]) for w in waiting) > 4_000_000:
                    yield merged()
        if waiting:
            yield merged()

    schema = "uid long, doc_id long, held_out boolean, n_tokens long, n_known long, head_sum double, rest_sum double, tail array<long>, tf array<int>, tail_group int, net double"
    scored = tables.written(docs.select("doc_id", "text", "held_out").mapInArrow(work, schema), "lm-scored")
    tail = scored.select("uid", F.explode(F.arrays_zip("tail", "tf")).alias("t")).select("uid", F.col("t.tail").alias("hash"), F.col("t.tf").alias("tf"))
    # The head's words don't occur in the tail, so no key here has more than 1/head of all tokens.
    joined = tail.join(counts.select("hash", "c"), "hash", "left")
    sums = joined.groupBy("uid").agg(
        F.sum(F.when(F.col("c") > 0, F.col("tf")).otherwise(0)).alias("tail_known"),
        F.sum(F.col("tf") * F.log10(F.coalesce(F.col("c"), F.lit(0)) + F.lit(0.1))).alias("tail_sum"),
    )
    norm = float(np.log10(lex.total + 0.1 * (lex.distinct + 1)))
    extra = F.coalesce("tail_sum", F.lit(0.0))
    return scored.drop("tail", "tf").join(sums, "uid", "left").select(
        "doc_id", "held_out", "n_tokens",
        (F.col("n_known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"),
        F.lit(lex.total).cast("long").alias("train_tokens"),
        (F.col("head_sum") + extra - F.col("n_tokens") * F.lit(norm)).alias("base_score"),
        (F.col("net") + F.col("rest_sum") + extra).alias("score"),
    )


def score_documents(docs: DataFrame, modulus: int = 10, remainder: int = 0) -> DataFrame:
    """Scores of ``docs``; those whose crc32(doc_id as text) leaves ``remainder`` are held out."""
    return score(tables.texts(docs).withColumn("held_out", tables.held_out(F.col("doc_id"), modulus, remainder)))
