import random


def test_ranks_of_many_buckets_settle_as_a_plain_loop_does(spark):
    """Parallel edges, loops, dangling nodes, a null target and a node whose out-edges weigh nothing."""
    from recollect.operators import graph

    draw = random.Random(5)
    whole = [(a, b, draw.random() + 0.1) for a in range(40) for b in draw.choices(range(40), k=4)]
    odd = whole + [(3, None, 2.0), (5, 70, 1.0), (6, 71, 1.0), (71, 1, 0.0), (None, 2, 1.0), (7, 8, None)]
    for edges in (whole, odd):
        seeds, total = [0, 10, 20, 30], {}
        for a, _, w in edges:
            total[a] = total.get(a, 0) + (w or 0)
        leave = {a for a, w in total.items() if w and a is not None}
        rank = {s: 0.25 for s in seeds}
        for _ in range(200):
            new, lost = {}, sum(v for k, v in rank.items() if k not in leave)
            for a, b, w in edges:
                if a in leave:
                    new[b] = new.get(b, 0) + 0.85 * rank.get(a, 0) * (w or 0) / total[a]
            for s in seeds:
                new[s] = new.get(s, 0) + (0.15 + 0.85 * lost) / 4
            rank = new
        frame = spark.createDataFrame(edges, "source long, target long, weight double").repartition(3)
        got = graph.personalised_rank(frame, spark.createDataFrame([(s,) for s in seeds], "node long"), block=30).collect()
        assert len(got) == len({r.node for r in got}) and abs(sum(r["rank"] for r in got) - 1) < 1e-6
        assert all(abs({r.node: r["rank"] for r in got}.get(k, 0) - v) < 1e-5 for k, v in rank.items() if v > 1e-10)
    assert graph.personalised_rank(frame, spark.createDataFrame([], "node long")).count() == 0
