from collections import defaultdict

import numpy as np
import pytest

from recollect.llm import components, neardup


def plain(rows, words):
    """Groups by all pairs: doc_id -> smallest id reachable, and set sizes."""
    sets = {}
    for k, x in rows:
        w = (x or "").encode().lower().split()
        sets[k] = frozenset(tuple(w[i : i + words]) for i in range(len(w) - words + 1)) if len(w) >= words else frozenset([tuple(w)]) if w else frozenset()
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    by = defaultdict(list)
    for k, s in sets.items():
        if s:
            by[s].append(k)
    reps = list(by)
    for s, ks in by.items():
        for k in ks[1:]:
            a, b = sorted((find(k), find(ks[0])))
            root[b] = a
    for i, s in enumerate(reps):
        for t in reps[:i]:
            n = len(s & t)
            if n and 100 * n >= 80 * (len(s) + len(t) - n):
                a, b = sorted((find(by[s][0]), find(by[t][0])))
                root[b] = a
    return {k: (len(s), find(k)) for k, s in sets.items()}


@pytest.mark.parametrize("words", [2, 5])
def test_groups_against_all_pairs(spark, texts, rng, words):
    rows = list(texts.items())
    vocab = [f"w{i}" for i in range(300)]
    base, k = [rng.choice(vocab) for _ in range(140)], 10**6
    for _ in range(60):  # a large group: most members are near the first, not near each other
        copy = list(base)
        for _ in range(rng.randrange(1, 9)):
            copy[rng.randrange(140)] = f"z{rng.random()}"
        rows.append((k := k + 1, " ".join(copy)))
    for _ in range(60):  # a passage that many share, in texts that are no copies
        rows.append((k := k + 1, " ".join(base[:90] + [f"q{rng.random()}" for _ in range(60)])))
    for i in range(30):  # a chain: neighbours are near, ends are not
        rows.append((k := k + 1, " ".join(f"c{j}" for j in range(i * 4, i * 4 + 70))))
    for _ in range(60):  # tiny sets
        rows.append((k := k + 1, " ".join(rng.choice("ab") for _ in range(rng.randrange(0, 9)))))
    want = plain(rows, words)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), words).collect()}
    assert got == {k: (n, c, c == k) for k, (n, c) in want.items()}


def test_copies_that_append_or_cut_around_the_sketch_sizes(spark, rng):
    rows, k = [], 0
    for n in [*range(33, 65, 2), *range(129, 257, 6)]:
        for share in (0.05, 0.1, 0.15, 0.2):
            text = [f"v{rng.random()}" for _ in range(n + 4)]  # n shingles of five words
            less = text[: len(text) - int(n * share)] if rng.random() < 0.5 else text[int(n * share) :]
            rows += [(k := k + 1, " ".join(text)), (k := k + 1, " ".join(less))]
            text = [f"v{rng.random()}" for _ in range(n + 4)]
            rows += [(k := k + 1, " ".join(text)), (k := k + 1, " ".join(text + [f"v{rng.random()}" for _ in range(int(n * share))]))]
    want = plain(rows, 5)
    got = {r.doc_id: r.component_id for r in neardup.groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), 5).collect()}
    lost = [k for k, (_, c) in want.items() if got[k] != c]
    assert len({c for _, c in want.values()}) < len(rows) * 0.55 and not lost, (len(lost), len(rows))


def test_components_of_chains_and_loops(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100), (7, 3), (200, 201), (201, 202), (202, 200)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {200: 200, 201: 200, 202: 200}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_odd_rows(odd, empty):
    rows = neardup.groups(odd).collect()
    assert len(rows) == odd.count()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in rows if r.doc_id in (1, 2, 3, 6, 8)} == {(1, 0, 1), (2, 0, 2), (3, 1, 3), (6, 0, 6), (8, 1, 3)}
    assert [r.kept for r in rows if r.doc_id is None] == [None]
    assert neardup.groups(empty).count() == 0
    kept = neardup.drop_near_copies(odd)
    assert kept.columns == odd.columns and 8 not in {r.doc_id for r in kept.collect()} and kept.where("doc_id IS NULL").count() == 1


def test_rows_that_repeat_an_id_are_linked_each_by_its_own_text(spark, rng):
    a, b = ([f"{x}{i}" for i in range(60)] for x in "ab")
    rows = [(5, " ".join(a)), (5, " ".join(b)), (7, " ".join(a[:-2])), (8, " ".join(b[:-2])), (9, "alone here"), (9, "alone here"), (None, " ".join(a)), (3, ""), (3, None)]
    docs = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in rows], "doc_id long, text string, _gone int, row int, first int").repartition(3)
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in neardup.groups(docs).collect()}
    assert got == {(5, 59, 5, True), (7, 57, 5, False), (8, 57, 5, False), (9, 1, 9, True), (None, 59, None, None), (3, 0, 3, True)}
    kept = neardup.drop_near_copies(docs, 2)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == sorted((i or 0, t or "") for i, t in [rows[0], rows[1], rows[4], rows[6], rows[7], rows[8]])


def test_an_id_whose_one_text_is_a_copy_keeps_its_other(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    docs = spark.createDataFrame([(3, a), (5, a), (5, b)], "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in neardup.drop_near_copies(docs).collect()) == [(3, a), (5, b)]


def test_blocks_dealt_out_to_cells(spark, rng, monkeypatch):
    """One group large enough for several cells, longer than sketches, many of whose members are not near its hub."""
    monkeypatch.setattr(neardup, "CELL", 16)
    base = [f"w{i}" for i in range(400)]
    rows = []
    for k in range(90):
        copy = list(base)
        for _ in range(rng.randrange(0, 40)):
            copy[rng.randrange(400)] = f"z{rng.randrange(60)}"
        rows.append((k, " ".join(copy)))
    want = plain(rows, 2)
    got = {r.doc_id: r.component_id for r in neardup.groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert got == {k: c for k, (_, c) in want.items()}
    assert 3 < len(set(got.values())) < 80


def drifted(rng, members, words=220, changes=20):
    """Copies of copies: each is near the one it was made from, many are not near each other."""
    texts = [[f"w{i}" for i in range(words)]]
    while len(texts) < members:
        copy = list(rng.choice(texts))
        for _ in range(rng.randrange(1, changes)):
            copy[rng.randrange(words)] = f"z{rng.random()}"
        texts.append(copy)
    return [(k, " ".join(t)) for k, t in enumerate(texts)]


@pytest.mark.parametrize("cell", [1024, 64])
def test_a_large_group_that_drifts_apart_costs_no_look_at_every_pair(spark, rng, monkeypatch, cell):
    """Full sets are put beside each other for a few pairs a member; each pair of the group, before."""
    looked, confirmed = [], neardup.confirmed

    def counted(rows, listed, pairs, words):
        looked.append(pairs.count())
        return confirmed(rows, listed, pairs, words)

    monkeypatch.setattr(neardup, "confirmed", counted)
    monkeypatch.setattr(neardup, "CELL", cell)
    rows = drifted(rng, 120)
    rows += [(1000 + k, " ".join([f"w{i}" for i in range(190)] + [f"q{rng.random()}" for _ in range(30)])) for k in range(100)]  # near the threshold, no links
    want = plain(rows, 2)
    got = {r.doc_id: r.component_id for r in neardup.groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert got == {k: c for k, (_, c) in want.items()}
    assert sum(looked) < 4 * len(rows), looked


def test_shared_values_of_a_cell_and_the_estimate_against_sets(rng):
    sets = [np.array(sorted(rng.sample(range(-3000, 3000), rng.randrange(1, 4000)))) for _ in range(30)]
    sets += [np.array(sorted(rng.sample(range(10**6), 5))) for _ in range(3)]
    left, right = np.array([0, 3, 4, *range(10, 20)]), np.array([1, 2, *range(20, 33)])
    got = neardup._shared(np.concatenate(sets), np.array([len(s) for s in sets]), left, right)
    assert got.tolist() == [[len(set(sets[a]) & set(sets[b])) for b in right] for a in left]
    # Sets of copies on both sides of the threshold, below and above the length of sketches.
    pairs = []
    for n in (1, 3, 50, 192, 193, 300, 2000):
        for share in (0, 0.05, 0.1, 0.11, 0.12, 0.2, 0.5):
            a = rng.sample(range(-(10**9), 10**9), n)
            pairs.append((set(a), set(a[int(n * share) :]) | set(rng.sample(range(2 * 10**9, 3 * 10**9), int(n * share)))))
    low = [[np.array(sorted(s)[: neardup.K]) for s in side] for side in zip(*pairs, strict=True)]
    na, nb = (np.array([len(s) for s in side]) for side in zip(*pairs, strict=True))
    got = neardup.may_link(*(neardup._padded(np.concatenate(side), np.array([len(s) for s in side])) for side in low), na, nb)
    for (a, b), may in zip(pairs, got.tolist(), strict=True):
        union = sorted(set(sorted(a)[: neardup.K]) | set(sorted(b)[: neardup.K]))[: neardup.K]
        both = len(set(union) & a & b)
        stray = 4.7 * (0.16 * len(union) * max(0, 1 - len(union) * 1.8 / (len(a) + len(b)))) ** 0.5
        assert may == (9 * len(a & b) >= 4 * (len(a) + len(b)) if max(len(a), len(b)) <= neardup.K else both >= np.floor(0.8 * len(union) - stray))


def test_forest_spans_and_prefers_the_first_edges(rng):
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(150)]
    root, want = list(range(80)), []
    for k, (a, b) in enumerate(edges):  # Kruskal
        while root[a] != a:
            a = root[a]
        while root[b] != b:
            b = root[b]
        if a != b:
            root[b] = a
            want.append(k)
    assert neardup.forest(*np.array(edges).T).tolist() == want
    assert neardup.forest(np.zeros(0, np.int64), np.zeros(0, np.int64)).tolist() == []
