"""Near-duplicate documents by bottom-k sketches.

One hash function orders all shingles; a document's sketch is its ``K`` lowest values. Rows with equal
sets form a class, of which one row goes on. Inverted lists of the retained values generate overlaps:
two sets at the threshold share a known least number of their k lowest values, so of any order of
values they share one of the first ``k - least + 1``; the order is rarest first, which leaves values
that only one class has, and common phrases, out of the lists. The lists are those of the ``FIRST``
lowest values. A list is compared with its most central member first; what is still apart after that
is compared across components. Candidates are filtered by the similarity estimated from the sketch of
the union; what remains is confirmed on full sets (which sketches of up to ``K`` values are) and
joined into components.

The sketch of a pair at the threshold falls below ``least_shared`` with a chance below 1.3e-6 (one
tail of 4.7 deviations); sets of up to 0.8 * FIRST shingles are never missed.

Rows are told apart by a number of their own, so rows repeating an id are documents of their own; each
is linked by its own text. Nulls: null or wordless text has an empty set and is linked with nothing. A
null doc_id is not linked, and component and kept are null. Extra columns are ignored by ``groups``
and kept by ``drop_near_copies``, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import arrays, tables
from .components import components

K = 192
FIRST = 64
#: A cell holds twice so many members, and values of members, at most.
CELL = 1024
VALUES = 250_000
#: Values that so many sketches of a cell hold at most are counted pair by pair.
FEW = 8
#: A cell offers all pairs that may be links up to so many for each member, a forest beyond.
SPARE = 4
PAIR = "hub long, member long, known boolean"
#: Ids up to this many are sent to all tasks to pick rows; beyond, rows and ids are joined by a shuffle.
SENT = 1_000_000


def shingle_sets(column: pa.Array, words: int, chunk: int = 4_000_000) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, sorted distinct 64-bit shingles of each text)."""
    for row, data, offsets in arrays.chunks(column, chunk, lower=True):
        starts, ends = arrays.word_bounds(data, int(offsets[-1]))
        h = arrays.hash_segments(data, starts, ends)
        bounds = np.searchsorted(starts, offsets)
        code = h.copy()
        for i in range(1, words):
            code[:-i] = arrays.mix(code[:-i] * np.uint64(0x9FB21C651E98DF25) + h[i:]) if i < len(h) else code[:-i]
        out = []
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if b - a >= words:
                out.append(np.unique(code[a : b - words + 1]))
            elif b > a:
                whole = h[a : a + 1] ^ np.uint64(b - a)
                for i in range(a + 1, b):
                    whole = arrays.mix(whole * np.uint64(0x9FB21C651E98DF25) + h[i : i + 1])
                out.append(whole)
            else:
                out.append(h[:0])
        yield row, out


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """uid (a number of the row's own, fixed once written), doc_id, th, n (set size), s1 and s2
    (digest of the set), sketch."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid = TaskContext.get().partitionId() << 33
        for batch in batches:
            for row, sets in shingle_sets(batch.column(2), words):
                n = np.array([len(s) for s in sets])
                low = [s[:K] for s in sets]
                cuts = np.concatenate(([0], np.cumsum([len(s) for s in low]))).astype(np.int32)
                digest = lambda salt: pa.array(np.array([np.bitwise_xor.reduce(arrays.mix(s + np.uint64(salt))) if len(s) else 0 for s in sets], dtype=np.uint64).view(np.int64))  # noqa: B023, E731
                # Top bit flipped: as signed longs they keep the order by which they are the lowest.
                flat = (np.concatenate(low) ^ np.uint64(1 << 63)).view(np.int64) if low else np.zeros(0, np.int64)
                ids = [pa.array(uid + np.arange(len(sets))), batch.column(0).slice(row, len(sets)), batch.column(1).slice(row, len(sets))]
                uid += len(sets)
                yield pa.RecordBatch.from_arrays([*ids, pa.array(n), digest(1), digest(2), pa.ListArray.from_arrays(pa.array(cuts), pa.array(flat))], ["uid", "doc_id", "th", "n", "s1", "s2", "sketch"])

    return docs.select("doc_id", "th", "text").mapInArrow(tables.lean(work), "uid long, doc_id long, th long, n long, s1 long, s2 long, sketch array<long>")


def full_sets(docs: DataFrame, words: int) -> DataFrame:
    """uid, shingles (array of longs) of rows (uid, text)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, sets in shingle_sets(batch.column(1), words):
                cuts = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(sets)), pa.ListArray.from_arrays(pa.array(cuts), pa.array(np.concatenate(sets).view(np.int64)))], ["uid", "shingles"])

    return docs.select("uid", "text").mapInArrow(tables.lean(work), "uid long, shingles array<long>")


def least_shared(k: int) -> int:
    """How many of the k lowest values of a union two sets at the threshold share at least, but for a
    chance below one in a million: 4.7 deviations of the binomial law, which is wider than the law
    that holds here (drawing without replacement)."""
    return int(0.8 * k - 4.7 * (0.16 * k) ** 0.5)


def candidate_lists(reps: DataFrame, k: int) -> DataFrame:
    """v, rep, n, central: the retained values under which a class representative is listed, by its
    ``k`` lowest values. Values that no other class retains take up the first places of the order, so
    a class with many of its own isn't listed at all. Each is listed by its size too, so that only sets
    of sizes that allow a link meet."""
    low = F.slice("sketch", 1, k)
    each = reps.select("rep", F.explode(low).alias("v"))
    shared = each.groupBy("v").agg(F.count("*").alias("df")).where(F.col("df") > 1)
    held = each.join(shared, "v").groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("df", "v"))).alias("vs")).join(reps.select("rep", "n"), "rep")
    # A partner of a set this small is itself no larger than the sketch, and both are known in full.
    whole = F.col("n") * 5 <= F.lit(k) * 4
    need = F.when(whole, F.ceil(F.col("n") * F.lit(4) / F.lit(5))).otherwise(F.lit(least_shared(k)))
    has = F.least(F.col("n"), F.lit(k))
    keys = (F.size("vs") - need + 1).cast("int")  # what is left of the first has - need + 1 places behind its own values
    # Sets whose sizes lie at most a quarter apart are in one step of size, or in two that follow each other.
    step = F.floor(F.log(F.col("n")) / F.log(F.lit(1.26)))
    central = F.struct(F.size("vs").alias("shared"), F.aggregate("vs", F.lit(0).cast("long"), lambda a, x: a + x["df"]).alias("mass"))
    return held.where((has > 0) & (keys > 0)).select("rep", "n", central.alias("central"), F.explode(F.slice("vs", F.lit(1), keys)).alias("x")).select(F.explode(F.array(*[F.xxhash64("x.v", step + d) for d in (0, 1)])).alias("v"), "rep", "n", "central")


def _sizes(a: str, b: str) -> Column:
    return (F.col(a) * 5 >= F.col(b) * 4) & (F.col(b) * 5 >= F.col(a) * 4)


def _padded(flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A row of ``K`` places for each sketch of a ragged array, filled up with the largest value."""
    out = np.full((len(sizes), K), np.iinfo(np.int64).max)
    out[np.arange(K) < sizes[:, None]] = flat
    return out


def _enough(both: np.ndarray, shared: np.ndarray, union: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Whether ``both`` values of a union's sketch of ``union`` values leave the similarity at the
    threshold. At the threshold the union has (na + nb) / 1.8 values; the nearer the sketch comes to all
    of them, the less the share in it can stray (4.7 deviations are allowed). Of sets that the sketches
    hold whole it is exact, by the ``shared`` values."""
    stray = 4.7 * np.sqrt(0.16 * union * np.maximum(0.0, 1 - union * 1.8 / (na + nb)))
    return np.where((na <= K) & (nb <= K), 9 * shared >= 4 * (na + nb), both >= np.floor(0.8 * union - stray))


def may_link(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Whether the sketch of the union of each row of ``a`` and ``b`` (padded sketches of sets of ``na``
    and ``nb`` values) leaves the similarity at the threshold."""
    held = np.minimum(na, K) + np.minimum(nb, K)
    values = np.sort(np.concatenate((a, b), axis=1), axis=1)
    again = (values[:, 1:] == values[:, :-1]) & (np.arange(1, 2 * K) < held[:, None])
    place = np.arange(2, 2 * K + 1) - np.cumsum(again, axis=1)  # in the union, of the value that comes again
    shared = again.sum(axis=1)
    return _enough((again & (place <= K)).sum(axis=1), shared, np.minimum(K, held - shared), na, nb)


def _ragged(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and sizes of an array of lists."""
    return column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy()).astype(np.int64)


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows (hub, member, na, nb, sa, sb) that may be links: hub, member, known."""
    for whole in batches:
        for at in range(0, whole.num_rows, 1024):
            batch = whole.slice(at, 1024)
            na, nb = (batch.column(c).to_numpy() for c in ("na", "nb"))
            on = may_link(*(_padded(*_ragged(batch.column(c))) for c in ("sa", "sb")), na, nb)
            yield pa.RecordBatch.from_arrays([*(batch.column(c).filter(pa.array(on)) for c in ("hub", "member")), pa.array(((na <= K) & (nb <= K))[on])], ["hub", "member", "known"])


def _shared(flat: np.ndarray, sizes: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many values each of ``left`` has in common with each of ``right`` (places of sketches in a
    ragged array). Values that few sketches hold are counted pair by pair, others by a product of matrices."""
    m = len(sizes)
    order = np.argsort(flat, kind="stable")
    value, who = flat[order], np.repeat(np.arange(m), sizes)[order]
    run = np.cumsum(np.diff(value, prepend=value[:1]) != 0)
    held = np.bincount(run)[run]
    few = held <= FEW
    v, w = run[few], who[few]
    row, col = np.full(m, -1), np.full(m, -1)
    row[left], col[right] = np.arange(len(left)), np.arange(len(right))
    out = np.zeros(len(left) * len(right), np.int64)
    for step in range(1, FEW):
        same = v[step:] == v[:-step]
        if not same.any():
            break
        a, b = w[:-step][same], w[step:][same]
        for r, c in ((row[a], col[b]), (row[b], col[a])):
            on = (r >= 0) & (c >= 0)
            out += np.bincount(r[on] * len(right) + c[on], minlength=len(out))
    out = out.reshape(len(left), len(right))
    number, w = np.unique(run[~few], return_inverse=True)[1], who[~few]
    for first in range(0, int(number.max(initial=-1)) + 1, 2048):
        part = (number >= first) & (number < first + 2048)
        holds = np.zeros((m, int(number[part].max()) - first + 1), np.float32)
        holds[w[part], number[part] - first] = 1
        out += (holds[left] @ holds[right].T).astype(np.int64)
    return out


def forest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of edges between nodes ``a`` and ``b``, the preferred ones first, those of a spanning forest that
    prefers the same way."""
    nodes, ends = np.unique(np.concatenate((a, b)), return_inverse=True)
    label, alive, chosen = np.arange(len(nodes)), np.arange(len(a)), []
    a, b = ends[: len(a)], ends[len(a) :]
    while True:
        alive = alive[label[a[alive]] != label[b[alive]]]
        if not len(alive):
            return np.sort(np.concatenate(chosen)) if chosen else alive
        x, y, best = label[a[alive]], label[b[alive]], np.full((2, len(nodes)), len(alive))
        best[0, x[::-1]] = best[1, y[::-1]] = np.arange(len(alive))[::-1]  # the first edge of each tree is written last
        best = best.min(axis=0)
        pick = np.unique(best[best < len(alive)])
        chosen.append(alive[pick])
        x, y, to = x[pick], y[pick], np.arange(len(nodes))
        while (to[x] != to[y]).any():
            low = np.minimum(to[x], to[y])
            np.minimum.at(to, x, low)
            np.minimum.at(to, y, low)
            to = to[to]
        label = to[label]


def _met(cell: pa.RecordBatch, every: bool) -> Iterator[pa.RecordBatch]:
    """hub, member, known of the pairs of one cell that are apart and may be links, by sketches. Where
    there are many, a spanning forest of its components by the shared values and a row of the block
    alone, which says so. With ``every``, ``held`` is the full set, and a forest of the links comes out."""
    block, i, j, rep, component, n, own = (cell.column(c).to_numpy() for c in ("block", "i", "j", "rep", "component", "n", "own"))
    if (component == component[0]).all():
        return
    flat, sizes = _ragged(cell.column("held"))
    left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
    shared = _shared(flat, sizes, left, right)
    x, y = np.nonzero(shared)
    shared, x, y = shared[x, y], left[x], right[y]
    # The union's sketch has no more values of both than the two sketches share.
    enough = (lambda: 9 * shared >= 4 * (n[x] + n[y])) if every else (lambda: _enough(shared, shared, np.minimum(K, sizes[x] + sizes[y] - shared), n[x], n[y]))
    for test in (lambda: (component[x] != component[y]) & ((i[0] != j[0]) | (x < y)), lambda: (n[x] * 5 >= n[y] * 4) & (n[y] * 5 >= n[x] * 4), enough):
        on = test()
        shared, x, y = shared[on], x[on], y[on]
    if every or len(x) > SPARE * len(rep):
        order = np.argsort(-shared / (sizes[x] + sizes[y] - shared), kind="stable")
        x, y = x[order], y[order]
        pick = forest(component[x], component[y])
        x, y = x[pick], y[pick]
        if not every:
            yield pa.RecordBatch.from_arrays([pa.array(block[:1]), pa.nulls(1, pa.int64()), pa.nulls(1, pa.bool_())], ["hub", "member", "known"])
    start = np.cumsum(sizes) - sizes
    for at in range(0, len(x), 1024):
        p, q = x[at : at + 1024], y[at : at + 1024]
        if not every:
            on = may_link(*(_padded(flat[arrays.spread(start[s], sizes[s])], sizes[s]) for s in (p, q)), n[p], n[q])
            p, q = p[on], q[on]
        a, b = rep[p], rep[q]
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array((n[p] <= K) & (n[q] <= K) | every)], ["hub", "member", "known"])


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """The runs of rows with equal ``keys``."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(c).to_numpy() for c in keys]
        cuts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
        cuts = [0, *cuts.tolist(), batch.num_rows]
        if held and any(held[-1].column(c)[-1].as_py() != x[0] for c, x in zip(keys, cols, strict=True)):
            yield pa.concat_batches(held)
            held = []
        for first, last in zip(cuts[:-1], cuts[1:], strict=True):
            held.append(batch.slice(first, last - first))
            if last < batch.num_rows:
                yield pa.concat_batches(held)
                held = []
    if held:
        yield pa.concat_batches(held)


def picked(rows: DataFrame, ids: DataFrame, key: str, how: str = "left_semi") -> DataFrame:
    """``rows`` joined with the written table ``ids`` on ``key``; few ids travel, not the rows."""
    return rows.join(F.broadcast(ids) if ids.count() <= SENT else ids, key, how)


def links(rows: DataFrame, reps: DataFrame, words: int, used: tuple[DataFrame, ...] = ()) -> DataFrame:
    """rep, component of the classes among ``reps`` (rep, doc_id, th, n, sketch) that have a near copy.
    ``used`` are tables behind ``reps``, deleted once they are read.

    Every list offers a star: its most central member (that with most shared values) and each other
    member. Lists with one hub then make up a block, and members of a block that are still in
    different components are compared, sketch against sketch, so that only what may be a link comes
    out; blocks above ``CELL`` members are dealt out to cells, each pair to one. A cell that has many such
    pairs offers a forest of them first, since most texts of a large group are joined by a few links; what
    that leaves apart is looked at again, by full sets once most of what forests offer is no link.
    """
    scratch = tables.Scratch()
    lists = scratch.written(candidate_lists(reps, FIRST), "dup-lists")
    hubs = lists.groupBy("v").agg(F.count("*").alias("m"), F.max(F.struct("central", (-F.col("rep")).alias("tie"), "rep", "n")).alias("h")).where("m > 1").select("v", F.col("h.rep").alias("hub"), F.col("h.n").alias("hub_n"))
    starred = scratch.written(lists.select("v", "rep", "n").join(hubs, "v"), "dup-stars")
    listed = scratch.written(picked(reps, scratch.written(starred.select("rep").distinct(), "dup-ids"), "rep"), "dup-listed")
    tables.discard(*used)
    spokes = starred.where((F.col("rep") != F.col("hub")) & _sizes("n", "hub_n")).select(F.least("rep", "hub").alias("a"), F.greatest("rep", "hub").alias("b"), "hub")
    pairs = spokes.groupBy("a", "b").agg(F.max("hub").alias("hub")).select("hub", F.when(F.col("hub") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("member"))
    pairs = scratch.written(pairs, "dup-pairs")
    near = picked(listed.select(F.col("rep").alias("member"), F.col("n").alias("na"), F.col("sketch").alias("sa")), pairs, "member", "inner")
    centres = picked(listed, scratch.written(pairs.select(F.col("hub").alias("rep")).distinct(), "dup-ids"), "rep")
    near = near.join(centres.select(F.col("rep").alias("hub"), F.col("n").alias("nb"), F.col("sketch").alias("sb")), "hub").select("hub", "member", "na", "nb", "sa", "sb")
    found = scratch.written(confirmed(rows, listed, scratch.written(near.mapInArrow(tables.lean(_compared), PAIR), "dup-checked"), words), "dup-links")
    where, blocks, every = components(found.select(F.col("hub").alias("a"), F.col("member").alias("b"))), None, False
    while True:
        met = scratch.written(_across(rows, starred, where, listed, words, scratch, blocks, every), "dup-checked")
        offered = met.where(F.col("member").isNotNull())
        more = offered if every else scratch.written(confirmed(rows, listed, offered, words), "dup-links")
        gained = more.count()
        if gained:
            last, where = where, components(where.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more.select(F.col("hub").alias("a"), F.col("member").alias("b"))))
            tables.discard(last)
        blocks = scratch.written(met.where(F.col("member").isNull()).select(F.col("hub").alias("block")), "dup-ids")
        if blocks.isEmpty():
            break
        every = gained * 2 <= offered.count()
    scratch.clear()
    return where.withColumnRenamed("node", "rep")


def _across(rows: DataFrame, starred: DataFrame, where: DataFrame, listed: DataFrame, words: int, scratch: tables.Scratch, blocks: DataFrame | None, every: bool) -> DataFrame:
    """hub, member, known of pairs that share a list of ``starred`` (v, rep, n, hub), aren't connected
    yet and may be links, and the blocks of which more such pairs are left (hub alone). Only ``blocks``
    are looked at, if given; with ``every``, their full sets, and links that connect all that is linked
    come out."""
    own = starred if blocks is None else picked(starred, blocks.withColumnRenamed("block", "hub"), "hub")
    own = own.join(where.withColumnRenamed("node", "rep"), "rep", "left").select("v", "rep", "n", "hub", F.coalesce("component", "rep").alias("component"))
    # A list of two has had its only pair compared.
    still = own.groupBy("v").agg(F.count("*").alias("m"), F.min("component").alias("lo"), F.max("component").alias("hi")).where((F.col("m") > 2) & (F.col("lo") < F.col("hi")))
    still = scratch.written(still.select("v"), "dup-ids")
    apart = scratch.written(picked(own, still, "v").select(F.col("hub").alias("block"), "rep", "n", "component").distinct(), "dup-blocks")
    # A block's largest component meets the others, not itself.
    held = F.col("n") if every else F.least("n", F.lit(K))
    of = apart.groupBy("block", "component").agg(F.count("*").alias("m"), F.sum(held).alias("values")).groupBy("block").agg(F.sum("m").alias("m"), F.sum("values").alias("values"), F.max(F.struct("m", "values", "component")).alias("main"))
    groups = lambda m, values: F.ceil(F.greatest(m / CELL, values / VALUES)).cast("int")
    one = groups(F.col("m"), F.col("values")) == 1
    of = of.select("block", F.col("main.component").alias("main"), F.when(one, 1).otherwise(groups(F.col("m") - F.col("main.m"), F.col("values") - F.col("main.values"))).alias("rest"), F.when(one, 0).otherwise(groups(F.col("main.m"), F.col("main.values"))).alias("mains"))
    places = apart.drop("n").join(of, "block")
    places = scratch.written(places.select("block", "rep", "component", "rest", "mains", ((F.col("component") == F.col("main")) & (F.col("mains") > 0)).alias("is_main")), "dup-places")
    if every:
        ids = scratch.written(places.select("rep").distinct(), "dup-ids")
        sets = _sets(rows, listed, ids, words, scratch).select(F.col("uid").alias("rep"), F.size("shingles").cast("long").alias("n"), F.col("shingles").alias("held"))
    else:
        sets = listed.select("rep", "n", F.col("sketch").alias("held"))
    number = F.xxhash64("rep")
    members = picked(sets, places, "rep", "inner").withColumn("own", F.when(F.col("is_main"), F.col("rest") + F.pmod(number, F.greatest("mains", F.lit(1)))).otherwise(F.pmod(number, F.col("rest"))).cast("int"))
    spread = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(F.col("is_main"), F.col("rest")).otherwise(F.col("rest") + F.col("mains")) - 1)))
    dealt = spread.select("block", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "rep", "component", "n", "held")
    cell = ["block", "i", "j"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in _runs(batches, cell):
            yield from _met(run, every)

    return dealt.repartition(*cell).sortWithinPartitions(*cell).mapInArrow(tables.lean(work), PAIR).distinct()


def _sets(rows: DataFrame, listed: DataFrame, ids: DataFrame, words: int, scratch: tables.Scratch) -> DataFrame:
    """uid, shingles of the classes in ``ids`` (rep), written."""
    ids = scratch.written(picked(listed, ids, "rep").select(F.col("rep").alias("uid"), F.col("doc_id").alias("id"), F.col("th").alias("h")), "dup-ids")
    wanted = F.broadcast(ids) if ids.count() <= SENT else ids
    return scratch.written(full_sets(rows.join(wanted, (F.col("doc_id") == F.col("id")) & (F.col("th") == F.col("h"))), words), "dup-sets")


def confirmed(rows: DataFrame, listed: DataFrame, pairs: DataFrame, words: int) -> DataFrame:
    """The written ``pairs`` (hub, member, known) that are links: known ones are, others when their full sets
    have a Jaccard similarity of 0.8 or more. A member's set is put to its pair,
    a hub's set only joined in at the end, so that it isn't moved once per pair."""
    scratch = tables.Scratch()
    open_pairs = pairs.where(~F.col("known")).select("hub", "member")
    ids = open_pairs.select(F.col("hub").alias("rep")).unionByName(open_pairs.select(F.col("member").alias("rep"))).distinct()
    sets = _sets(rows, listed, scratch.written(ids, "dup-ids"), words, scratch)
    both = open_pairs.join(sets.select(F.col("uid").alias("member"), F.col("shingles").alias("sa")), "member").join(sets.select(F.col("uid").alias("hub"), F.col("shingles").alias("sb")), "hub")
    linked = both.where(9 * F.size(F.array_intersect("sa", "sb")) >= 4 * (F.size("sa") + F.size("sb"))).select("hub", "member")
    out = tables.written(pairs.where("known").select("hub", "member").unionByName(linked), "dup-confirmed")
    scratch.clear()
    return out


def placed(docs: DataFrame, words: int) -> DataFrame:
    """A row for each row of ``docs``: doc_id, th (hash of the text), n (set size), component (the
    smallest doc_id of its group), first (whether the row is the one that stands for its group)."""
    rows = tables.texts(docs).withColumn("th", F.xxhash64("text"))
    held = tables.written(sketches(rows, words), "dup-sketches")
    slim = tables.written(held.drop("sketch"), "dup-rows")
    some = slim.where((F.col("n") > 0) & F.col("doc_id").isNotNull())
    classes = tables.written(some.groupBy("s1", "s2", "n").agg(F.min(F.struct("doc_id", "uid")).alias("least")).select("s1", "s2", "n", F.col("least.doc_id").alias("lo"), F.col("least.uid").alias("rep")), "dup-classes")
    copies = tables.written(some.join(classes.select("rep"), F.col("uid") == F.col("rep"), "left_anti").select("uid"), "dup-copies")
    whole = held.where((F.col("n") > 0) & F.col("doc_id").isNotNull())
    reps = picked(whole, copies, "uid", "left_anti").select(F.col("uid").alias("rep"), "doc_id", "th", "n", "sketch")
    where = links(rows, reps, words, (held, copies))
    linked = classes.join(where, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    heads = linked.groupBy("component").agg(F.min(F.struct("lo", "rep")).alias("head"))
    of_class = linked.join(heads, "component").select("s1", "s2", "n", F.col("head.lo").alias("least_id"), F.col("head.rep").alias("head"))
    out = slim.join(of_class, ["s1", "s2", "n"], "left")
    alone = (F.col("n") == 0) | F.col("doc_id").isNull()
    return out.select("doc_id", "th", "n", F.when(alone, F.col("doc_id")).otherwise(F.col("least_id")).alias("component"), (alone | (F.col("uid") == F.col("head"))).alias("first"))


def groups(docs: DataFrame, words: int = 2) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each document, linked at a Jaccard similarity of 0.8
    or more over distinct ``words``-word shingles."""
    out = placed(docs, words)
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), (F.col("doc_id") == F.col("component")).alias("kept"))


def drop_near_copies(docs: DataFrame, words: int = 5) -> DataFrame:
    """The rows of ``docs``, all columns, of which one of each group stays: that with the smallest id,
    one of them where rows with that id are copies of each other. Rows without words or id all stay."""
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"))
    decided = tables.written(placed(docs, words).groupBy("doc_id", "th").agg(F.max("first").alias("stays"), F.max((F.col("n") > 0) & F.col("doc_id").isNotNull()).alias("linkable"), F.count("*").alias("rows")), "dup-decided")
    key = F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("h") == F.col("th"))
    gone = decided.where(~F.col("stays"))
    kept = whole.join(gone.select("doc_id", "th"), key, "left_anti")
    repeated = decided.where("stays and linkable and rows > 1").select("doc_id", "th")
    if not repeated.isEmpty():
        kept = kept.join(repeated, key, "left_anti").unionByName(kept.join(repeated, key, "left_semi").dropDuplicates(["id", "h"]))
    return kept.select("row.*")
