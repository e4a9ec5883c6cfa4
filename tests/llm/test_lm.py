import math
import zlib
from collections import Counter

import numpy as np

from recollect.llm import lm


def test_scores_against_a_plain_version(documents, texts):
    got = {r.doc_id: r for r in lm.score_documents(documents).collect()}
    words = {k: [*t.encode().lower().split(), None] for k, t in texts.items()}
    c = Counter(w for k, ws in words.items() if zlib.crc32(str(k).encode()) % 10 for w in ws)
    total, distinct = sum(c.values()), len(c)
    assert got.keys() == words.keys()
    for k, ws in words.items():
        r = got[k]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (zlib.crc32(str(k).encode()) % 10 == 0, len(ws), sum(w in c for w in ws), total)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in ws), rel_tol=1e-9)
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_probabilities_of_symbols_sum_to_one():
    model = lm.Model.fresh(4, 4, 8, np.ones(16))
    for end_first in ([], [3, 5]):
        total = 0.0
        for s in range(16):
            flat = np.array([*end_first, s], dtype=np.int32)
            states = model.run(np.zeros((1, 8), np.float32), np.array([[0, *end_first]], dtype=np.int32).T, [1] * (len(flat)), False)[1]
            total += math.exp(float(model.losses(states[-1], np.array([s]))[0][0]))
        assert abs(total - 1) < 1e-5


def test_gradients_against_differences():
    rng = np.random.default_rng(0)
    model = lm.Model.fresh(3, 4, 5, np.ones(12))
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    x, y = rng.integers(0, 12, (6, 4)), rng.integers(0, 12, (6, 4))

    def loss(keep=False):
        h, out, saved = model.run(np.zeros((4, 5)), x, [4] * 6, keep)
        return out, saved

    out, saved = loss(True)
    grad = {}
    _, d = model.losses(out.reshape(-1, 5).astype(np.float64), y.ravel(), grad)
    model.backward(x, [4] * 6, saved, d.reshape(out.shape), grad)
    for name in ("X", "U", "C", "W", "wb"):
        flat = model.p[name].ravel()
        for i in rng.choice(flat.size, 4, replace=False):
            kept, step = flat[i], 1e-2
            values = []
            for v in (kept + step, kept - step):
                model.p[name].ravel()[i] = v
                values.append(-float(model.losses(loss()[0].reshape(-1, 5).astype(np.float64), y.ravel())[0].sum()))
            model.p[name].ravel()[i] = kept
            assert abs((values[0] - values[1]) / (2 * step) - grad[name].ravel()[i]) < 2e-2


def test_state_is_carried_through_long_texts():
    model = lm.Model.fresh(4, 4, 8, np.ones(16), seed=3)
    flat = np.random.default_rng(1).integers(0, 16, 700).astype(np.int32)
    whole = lm.log_likelihood(model, flat, np.array([700]), 0)[0]
    h, total, last = np.zeros((1, 8), np.float32), 0.0, 0
    for s in [*flat.tolist(), 0]:
        h, out, _ = model.run(h, np.array([[last]]), [1], False)
        total += float(model.losses(out[0], np.array([s]))[0][0])
        last = s
    assert abs(whole - total / math.log(10)) < 1e-2


def test_odd_rows(odd, empty):
    rows = lm.score_documents(odd).collect()
    assert len(rows) == odd.count() and all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in rows)
    assert {r.n_tokens for r in rows if r.doc_id in (1, 2, 6)} == {1}
    assert lm.score_documents(empty).count() == 0


def test_training_has_one_end_a_text_and_carries_its_state():
    rng = np.random.default_rng(4)
    sizes = np.array([0, 3, 50, 7, 0, 20])
    flat = rng.integers(1, 16, sizes.sum()).astype(np.int32)
    seen = []
    for cut in (5, 2048):
        model = lm.Model.fresh(4, 4, 8, np.ones(16))
        kept = lm.Model.run
        heard = []
        lm.Model.run = lambda self, h, x, live, keep, kept=kept, heard=heard: (heard.append([x[t, :n].tolist() for t, n in enumerate(live)]), kept(self, h, x, live, keep))[1]
        try:
            assert lm.train(model, iter([(flat, sizes)]), 0, 0.0, cut=cut) == sizes.sum() + len(sizes)
        finally:
            lm.Model.run = kept
        seen.append(sorted(i for w in heard for step in w for i in step))
    assert seen[0] == seen[1] and seen[0].count(0) == len(sizes)  # the end is an input where texts begin, nowhere else
