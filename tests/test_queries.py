"""Every registered query of the engine against its SQL, or a plain version where SQL can't say it."""

from collections import Counter, defaultdict

import numpy as np
import pytest

from recollect.plans.registry import FLAGSHIP, ORACLE, QUERIES


def table(rows, columns):
    order = sorted(columns)
    return sorted((tuple(r[columns.index(c)] for c in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    got = table([tuple(r) for r in df.collect()], df.columns)
    found = duck.execute(ORACLE[name])
    columns = [x[0] for x in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert got == table(found.fetchall(), columns)


def test_flagship_and_names():
    assert FLAGSHIP in QUERIES and set(ORACLE) <= set(QUERIES)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_context_budget_is_the_greedy_walk(spark, sf_dir):
    docs = [(r.doc_id, r.source, len(r.text.encode())) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want = set()
    by = defaultdict(list)
    for i, source, size in docs:
        by[source].append((round((i % 97) / 97.0, 6), -(-size // 4), i))
    for rows in by.values():
        left = 400
        for score, tokens, i in sorted((r for r in rows if r[1] > 0), key=lambda r: (-r[0] / r[1], -r[0], r[2])):
            if tokens <= left:
                left -= tokens
                want.add(i)
    assert {r.id for r in QUERIES["context_budget"](spark, sf_dir).collect()} == want


def test_topics_are_the_plain_loop(spark, sf_dir):
    by = defaultdict(list)
    for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect():
        by[r.conv_id].append((r.turn, r.text))
    want = {}
    for conv, turns in by.items():
        heads = []
        for turn, text in sorted(turns):
            words = set(text.lower().split())
            sims = [len(words & w) / max(1, len(words | w)) for _, w in heads]
            best = int(np.argmax(sims)) if sims else -1
            if best < 0 or (sims[best] <= 0.2 and len(heads) < 20):
                heads.append((text[:40], words))
                best = len(heads) - 1
            want[conv, turn] = heads[best][0]
    assert {(r.conv_id, r.id): r.topic for r in QUERIES["topic_clusters"](spark, sf_dir).collect()} == want


def test_trigram_embeddings_against_a_plain_version(spark, sf_dir):
    def embed(text):
        b, v = text.encode(), np.zeros(64)
        for i in range(len(b) - 2):
            v[((((b[i] * 31 + b[i + 1]) * 31 + b[i + 2]) + i) % 2**32) % 64] += 1
        n = np.linalg.norm(v)
        return v / n if n else np.eye(64)[0]

    rows = {r.conv_id * 1000 + r.turn: r.text for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect()}
    first = embed(rows[min(rows)])
    got = {r.id: r.similarity for r in QUERIES["trigram_embeddings"](spark, sf_dir).collect()}
    assert got.keys() == rows.keys()
    assert all(abs(got[i] - float(embed(t) @ first)) < 2e-6 for i, t in rows.items())


def test_communities_against_a_plain_loop(spark, sf_dir):
    from recollect.sources.views import supply_edges

    edges = [(r.source, r.target, r.weight) for r in supply_edges(spark, sf_dir).where("weight >= 0.5").collect()]
    around = defaultdict(list)
    for a, b, w in edges:
        around[a].append((b, w))
        around[b].append((a, w))
    label = {n: n for n in around}
    for _ in range(4):
        new = {}
        for n, near in around.items():
            votes = Counter()
            for m, w in near:
                votes[label[m]] += w
            new[n] = min(votes, key=lambda c: (-round(votes[c], 9), c))
        label = new
    assert {r.node: r.community for r in QUERIES["communities"](spark, sf_dir).collect()} == label
