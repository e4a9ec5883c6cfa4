"""Page extraction, quality, decontamination and code search."""

import html as htmllib
import re
import zlib

import numpy as np
import pytest

from recollect.llm import decontam, hamming, html_extract, quality


def test_extraction_of_the_table_s_pages(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    source = {r.page_id: r.html for r in pages.collect()}
    for r in html_extract.extract(pages).collect():
        article = source[r.page_id].split("<article>")[1].split("</article>")[0]
        blocks = [" ".join(htmllib.unescape(re.sub("<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split("</?p>|</?h1>", article)]
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


PAGE = """<html><head><title>T</title></head><body><header class="site-header"><div class="logo">Site name here today.</div><ul class="menu"><li><a href=x>Home</a><li><a>About</a></ul></header>
<div class="cookie-notice"><p>We use cookies on this site. Accept them now please.</p></div><div id="content"><div class="post"><h2>The heading</h2><p>First paragraph of the text, with some <a>link</a> in it. And more of it here.</p>
<div class="advert"><p>Buy this thing now. It is great.</p></div><p>Second paragraph &amp; more text&nbsp;here; it goes on for a while.</p></div><div class="comments"><h3>Comments</h3><div class="comment"><p>I disagree with all of this. It is wrong.</p></div></div></div>
<aside><p>Related reading is here for you.</p></aside><form><label>Name</label><input><textarea>x</textarea></form><footer><p>Copyright by someone. All rights reserved.</p></footer></body></html>"""


def test_extraction_of_another_layout():
    assert html_extract.text_of(PAGE, html_extract.Potentials()) == "The heading\nFirst paragraph of the text, with some link in it. And more of it here.\nSecond paragraph & more text here; it goes on for a while."


def test_messages_give_exact_marginals():
    rng = np.random.default_rng(2)
    parent, n = np.array([-1, 0, 0, 1, 1, 3]), 6
    kind, node, pair = rng.integers(0, 3, n), rng.standard_normal((n, 2)), rng.standard_normal((3, 2, 2))
    weight = np.zeros(n)
    total = 0.0
    for bits in range(2**n):
        y = [(bits >> i) & 1 for i in range(n)]
        w = np.exp(sum(node[i, y[i]] for i in range(n)) + sum(pair[kind[p], y[p], y[i]] for i, p in enumerate(parent) if p >= 0))
        total += w
        weight += w * np.array(y)
    got, both, z = html_extract.marginals(parent, html_extract.depths(parent), kind, node, pair)
    assert np.allclose(got[:, 1], weight / total) and np.isclose(z[0], np.log(total)) and np.allclose(both[1:].sum((1, 2)), 1)


def test_odd_pages(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "<p>a<p>b <b>c<i>d"), (4, "u", "plain"), (5, "u", "<div>" * 3000 + "deep"), (6, "u", "<script>no</script"), (6, "u", "<!-- cut"), (7, "u", "<p>x</p></div></p><a"), (None, "u", "<p>" + "long text. " * 20000)]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, text int")
    out = html_extract.extract(pages).collect()
    assert len(out) == len(rows) and {r.page_id: r.text for r in out}[3] == "a\nb cd" and all(r.text == "" for r in out if r.page_id in (1, 2, 6))
    assert html_extract.extract(pages.limit(0)).count() == 0


def test_quality_on_held_out_labels(spark, duck):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    truth = {r.doc_id: r.quality for r in labels.collect()}
    rows = quality.score_documents(docs, labels).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    held = [r.predicted == truth[r.doc_id] for r in rows if r.held_out and r.doc_id in truth]
    assert sum(held) / len(held) > 0.97


def test_votes_against_plain_cosines():
    rng = np.random.default_rng(0)
    counts = rng.poisson(1.0, (40, quality.TERMS + quality.STYLE)).astype(np.float32)
    voters = quality.Voters([(np.flatnonzero(x), x[np.flatnonzero(x)]) for x in counts[:30]], rng.integers(0, 2, 30), 8, 5)
    z = quality.unit(quality.weighted(counts, voters.idf) @ voters.axes)
    for i, got in enumerate(voters.score(counts, block=7)):
        cos = z[i] @ voters.vectors.T
        near = np.argsort(-cos)[:5]
        w = np.maximum(cos[near], 0) ** 8
        assert abs(got - (w @ voters.labels[near]) / w.sum()) < 1e-4


def test_quality_of_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(3, 1, 0), (4, 0, 0), (5, None, 0), (None, 1, 0), (3, 1, 1)], "doc_id long, quality int, toxic int")
    assert quality.score_documents(odd, labels).count() == odd.count() and quality.score_documents(empty, labels).count() == 0
    none = quality.score_documents(odd, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
    assert quality.keep_good(odd, labels).columns == odd.columns


def edited(words, share, rng):
    words = list(words)
    for _ in range(int(len(words) * share)):
        p, kind = rng.randrange(len(words)), rng.random()
        if kind < 0.34:
            words[p] = f"zz{rng.random()}"
        elif kind < 0.67:
            del words[p]
        else:
            words.insert(p, f"yy{rng.random()}")
    return words


def test_leaks_exact_and_edited(spark, sf_dir, texts, rng):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    wanted = [(r.item_id, r.text) for r in items.collect()]
    rows, planted, k = list(texts.items()), {}, 10**6
    pool = [t.split() for t in texts.values() if len(t.split()) > 50]
    for share in (0.0, 0.1, 0.2):
        for i, t in wanted:
            rows.append((k := k + 1, " ".join(rng.choice(pool)[:80] + edited(t.split(), share, rng) + rng.choice(pool)[:40])))
            planted[k] = (i, share)
    got = {(r.doc_id, r.item_id): r for r in decontam.matches(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), items).collect()}
    for share, least in ((0.0, 1.0), (0.1, 0.99), (0.2, 0.95)):
        hits = [(k, i) in got for k, (i, s) in planted.items() if s == share]
        assert sum(hits) / len(hits) >= least
    spaced = {k: b" " + b" ".join(t.encode().lower().split()) + b" " for k, t in texts.items()}
    exact = {(k, i) for k, t in spaced.items() for i, x in wanted if b" " + b" ".join(x.encode().lower().split()) + b" " in t}
    assert exact <= got.keys() and all(r.edits <= 0.2 * r.item_words for r in got.values())


def test_leaks_of_every_length(spark, rng):
    items, rows, planted, k = [], [], {}, 0
    for n in (1, 2, 3, 5, 6, 8, 10, 12, 16, 20, 23, 24, 30):
        for _ in range(100):
            items.append((k := k + 1, " ".join(f"w{rng.random()}" for _ in range(n))))
            for share in (0.0, 0.1, 0.2):
                around = [[f"a{rng.random()}" for _ in range(30)] for _ in range(2)]
                rows.append((len(rows), " ".join(around[0] + edited(items[-1][1].split(), share, rng) + around[1])))
                planted[len(rows) - 1] = (k, n, share)
    found = decontam.matches(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string"))
    got = {(r.doc_id, r.item_id): r for r in found.collect()}
    for n in sorted({n for _, n, _ in planted.values()}):
        for share, least in ((0.0, 1.0), (0.1, 0.99), (0.2, 1.0 if n < decontam.SHORT else 0.95)):
            hits = [got.get((k, i)) for k, (i, m, s) in planted.items() if (m, s) == (n, share)]
            assert sum(r is not None for r in hits) >= least * len(hits), (n, share, hits.count(None))
            assert all(r.edits <= int(n * share) for r in hits if r)
    assert all(planted[k][0] == i for k, i in got)


def test_short_leaks_against_every_passage(spark, rng):
    vocab = "abcde"
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randrange(1, 14)))) for i in range(60)]
    rows = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randrange(1, 40)))) for i in range(80)]
    want, code = {}, {c: j for j, c in enumerate(vocab)}
    for d, t in rows:
        for i, x in items:
            a, b = (np.array([code[c] for c in y.split()], dtype=np.uint64) for y in (x, t))
            cost = decontam.least_edits(a, b)[0]
            if cost <= len(a) // 5:
                want[d, i] = cost
    found = decontam.matches(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id): r.edits for r in found.collect()} == want


def test_least_edits_against_a_plain_table(rng):
    for _ in range(200):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(1, 9))] for _ in range(2))
        best = len(a)
        for s in range(len(b) + 1):
            row = list(range(len(a) + 1))
            for e in range(s, len(b) + 1):
                best = min(best, row[-1])
                if e < len(b):
                    new = [row[0] + 1]
                    for i, x in enumerate(a):
                        new.append(min(row[i + 1] + 1, new[i] + 1, row[i] + (x != b[e])))
                    row = new
        cost, s, e = decontam.least_edits(np.array(a, dtype=np.uint64), np.array(b, dtype=np.uint64))
        assert cost == best and 0 <= s <= e <= len(b)


def test_leaks_of_odd_rows(spark, odd, empty):
    items = spark.createDataFrame([(1, None), (2, ""), (None, "one"), (3, "no id here")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.matches(odd, items).collect()}
    assert got == {(3, None), (8, None), (None, 3)}
    assert decontam.matches(empty, items).count() == 0 and decontam.matches(odd, items.limit(0)).count() == 0
    left = decontam.drop_contaminated(odd, items)
    assert left.columns == odd.columns and {r.doc_id for r in left.collect()} == {1, 2, 4, 5, 6, 7}


@pytest.mark.parametrize("clustered", [False, True])
def test_top_k_against_brute_force(clustered):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, 8 if clustered else 3000, dtype=np.int64).astype(np.uint64)
    code = base[rng.integers(0, len(base), 3000)] ^ (np.uint64(1) << rng.integers(0, 64, 3000).astype(np.uint64)) if clustered else base
    ids = np.arange(3000)
    q, r, d = hamming.Segments(ids, code).nearest(ids[:60], code[:60], 10)
    for i in range(60):
        dist = np.bitwise_count(code ^ code[i]).astype(int)
        want = [(int(dist[j]), j) for j in np.lexsort((ids, dist)) if j != i][:10]
        assert sorted(zip(d[q == i].tolist(), r[q == i].tolist(), strict=True)) == want


def test_top_k_against_sql(spark, sf_dir, duck):
    got = {tuple(r) for r in hamming.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).collect()}
    assert got == set(duck.execute(hamming.ORACLE).fetchall())


def test_top_k_of_odd_rows(spark):
    rows = [(20, [1.0, -1.0]), (20, [1.0, -1.0]), (1, [1.0, 1.0]), (2, None), (None, [1.0, 1.0]), (3, [1.0, None]), (4, []), (40, [-1.0] * 70)]
    e = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, id string")
    out = hamming.top_k(e).collect()
    assert {r.query_id for r in out} == {20, 40} and all(r.neighbor_id != r.query_id for r in out)
    assert hamming.top_k(e.limit(0)).count() == 0
