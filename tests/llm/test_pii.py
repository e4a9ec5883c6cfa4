import hashlib
import math
import re

from recollect.llm import pii

KINDS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"), "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(reversed(digits))) % 10 == 0


def ok(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def plain(text):
    return [(kind, m.start(), m.end()) for kind, p in KINDS.items() for m in p.finditer(text) if ok(kind, m[0])]


def test_base_spans_against_plain_patterns(spark, texts, rng):
    rows = list(texts.items())
    rows += [(10**9 + i, "".join(rng.choice("0123456789  --..+@ab(Z)é😀_%\n") for _ in range(rng.randrange(0, 80)))) for i in range(1500)]
    rows += [(2 * 10**9, "a" * 50_000 + "@"), (2 * 10**9 + 1, "1 " * 30_000), (2 * 10**9 + 2, "a.b." * 20_000 + "@x.y." + "z." * 20_000 + "q")]
    rows += [(2 * 10**9 + 3, "4111 1111-1111 1111, +1 (555) 010-9999 1.2.3.4.5.6.7.8 300.1.1.1 000255.0.0.1 a@b.c_d@e.fg foo@bar@baz.com")]
    got = {r.doc_id: r for r in pii.spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, text in rows:
        want = plain(text)
        shown = ",".join(f"{a}:{b}:{c}" for a, b, c in want)
        r = got[k]
        assert r.base_sha256 == hashlib.sha256(shown.encode()).hexdigest() and r.spans.startswith(shown), (text[:200], shown, r.spans)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x[0] == kind for x in want) for kind in KINDS]


def test_terms_that_reveal_a_value(spark):
    places = ["alpha", "bravo", "charlie", "delta", "echoes", "foxtrot", "golfing", "hotelier"]
    rows = [(i, f"writes Zanthony from {w} about things to jo@corp.example and {w}{w} common") for i, w in enumerate(places)]
    rows += [(100 + i, f"common words about many other things from {i} and {i * 7}") for i in range(200)]
    rows += [(400 + i, "secretive passage copied to everyone at pat@corp.example without change") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    shown = {r.doc_id: r.spans for r in pii.spans(docs).collect()}
    assert all("term:7:15" in shown[i] for i in range(8))  # the name goes with the address everywhere
    assert all(not shown[100 + i] for i in range(200)) and all("term" not in shown[400 + i] for i in range(30))  # one passage copied reveals nothing
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert all("Zanthony" not in clean[i] and "jo@" not in clean[i] and places[i] in clean[i] for i in range(8))
    assert clean[100] == dict(rows)[100]


def test_terms_anywhere_in_the_text_against_plain_counts(spark, rng):
    filler = ["some", "plain", "words", "that", "say", "nothing", "much", "at", "all", "é9"]
    far = lambda n: " ".join(rng.choice(filler) for _ in range(n))
    rows = [(i, f"Bo K9x {far(60)} near{i} box{i} at{i}x by{i}y mail jo@corp.example {far(60)} {'Zed' if i % 2 else 'ab'}") for i in range(8)]
    rows += [(50 + i, far(80) + (" zed" if i < 3 else "")) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    term = re.compile(r"(?<![^\W_@.])(?=[0-9]*[^\W\d_])[^\W_]+(?!@)")
    kinds = {}
    own = [set(t for t in term.findall(text.lower()) if t not in ("jo", "corp", "example")) for _, text in rows]
    for t in set().union(*own[:8]):
        n, n_v, n_vt, n_t = len(rows), 8, sum(t in o for o in own[:8]), sum(t in o for o in own)
        if n_vt >= 3 and math.log2(n * n_vt / (n_v * n_t)) / math.log2(n / n_v) >= 0.75:
            kinds[t] = "" if math.log2(n * n_vt / (n_v * n_t)) / math.log2(n / n_v) >= 0.95 else "[TERM]"
    assert {"bo", "k9x"} <= set(kinds) and not set(filler) & set(kinds)
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    for k, text in rows:
        want = re.sub(r"[^\W_]+", lambda m: kinds.get(m[0].lower(), m[0]), text.replace("jo@corp.example", "[EMAIL]")) if k < 50 else text
        assert clean[k] == want


def test_overlapping_spans_go_as_one(spark):
    r = pii.sanitise(spark.createDataFrame([(1, "call +4111 1111 1111 1111 now", 9)], "doc_id long, text string, row long")).first()
    assert r.text in ("call [PHONE] now", "call +[CARD] now") and r.row == 9


def test_odd_rows(odd, empty):
    assert pii.spans(odd).count() == odd.count() and pii.spans(empty).count() == 0
    out = pii.sanitise(odd)
    assert out.columns == odd.columns and sorted(map(repr, out.collect())) == sorted(map(repr, odd.collect()))
    assert not any("Python" in line or "Arrow" in line for line in out._jdf.queryExecution().executedPlan().toString().splitlines())
