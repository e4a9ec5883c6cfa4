"""Personal data: found by form, and by what the corpus shows to reveal it.

Emails, IP addresses, card and phone numbers are found by form. All terms of the texts that hold such
a protected value are judged by information theory: with n texts, a value v in n_v of them, a term t
in n_t and both in n_vt, the pointwise mutual information log2(n * n_vt / (n_v * n_t)) says how many
of the log2(n / n_v) bits of v the term gives away. From ``generalise`` of those bits on, a term is
generalised, from ``remove`` on it is removed, in all texts that hold the value. A term is a run of
letters and digits with a letter in it, of any length. It is judged when the texts that hold it show
the value in ``support`` different surroundings (the words around the value), so that one passage
copied many times reveals nothing about its words.

Only DataFrame functions run here. Patterns are written so that the regular-expression engine
neither backtracks over long runs nor recurses, whatever the length of a text.

Nulls: null text is empty and holds nothing; null ids are kept. Repeated rows are treated alike,
copies under other ids each count as a text. Extra columns are ignored by ``spans`` and kept by
``sanitise``. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import tables

KINDS = ("email", "ip", "card", "phone")
LOCAL = "[A-Za-z0-9._%+-]"
# A match may begin where the last one ended or where a run begins: other places of a run fail alike.
EMAIL = rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
JOINT = ""  # stands for a blank or dash between two digits
CARD = f"[0-9][0-9{JOINT}]++"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
TERM = r"(?<![\p{L}\p{N}@.])(?=\p{N}*+\p{L})[\p{L}\p{N}]++(?!@)"
#: What tells two surroundings of a value apart: the nearest words, up to six a side of 80 characters.
WORD = r"(?<![\p{L}\p{N}@.])\p{L}{4,40}(?![\p{L}\p{N}@])"
AROUND = 80
NEAR = 6
#: Values or terms up to this many are sent to all tasks; beyond, they are joined by a shuffle.
SENT = 500_000
FOUND = "array<struct<kind:int,start:int,end:int,value:string>>"


def places(text: Column, pattern: str | Column, kind: int) -> Column:
    """All matches as (kind, start, end, value), in code points. What ``split`` leaves between the
    matches and the matches themselves add up to the text, so running sums give the places."""
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    pairs = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, pattern, F.lit(0)), lambda gap, hit: F.struct(F.length(gap).alias("gap"), hit.alias("hit")))
    start = F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as {FOUND})").alias("out"))

    def add(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["gap"]
        end = begin + F.length(x["hit"])
        new = F.struct(F.lit(kind).alias("kind"), begin.alias("start"), end.alias("end"), x["hit"].alias("value"))
        return F.when(x["hit"].isNull(), acc).otherwise(F.struct(end.alias("at"), F.concat(acc["out"], F.array(new)).alias("out")))

    return F.aggregate(pairs, start, add, lambda acc: acc["out"])


def _byte(part: Column) -> Column:
    bare = F.ltrim(part, F.lit("0"))
    return (F.length(bare) <= 3) & (F.when(bare == "", 0).otherwise(F.substring(bare, 1, 3).cast("int")) <= 255)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, n - i + 1, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(i % 2 == 1, d).when(twice > 9, twice - 9).otherwise(twice)

    return F.when((n >= 13) & (n <= 19), F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0).otherwise(False)


def base_spans(text: Column) -> Column:
    """Emails, IP addresses, cards and phones of a text, by kind, then place."""
    none = F.expr(f"cast(array() as {FOUND})")
    joined = F.regexp_replace(F.translate(text, JOINT, "x"), "(?<=[0-9])[ -](?=[0-9])", JOINT)
    email = F.when(F.contains(text, F.lit("@")), places(text, EMAIL, 0)).otherwise(none)
    ip = F.when(F.rlike(text, F.lit(r"[0-9]\.[0-9]")), F.filter(places(text, IP, 1), lambda x: F.forall(F.split(x["value"], r"\."), _byte))).otherwise(none)
    card = F.when(F.rlike(text, F.lit("[0-9](?:[ -]?[0-9]){12}")), F.filter(places(joined, CARD, 2), lambda x: _luhn(_digits(x["value"])))).otherwise(none)
    phone = F.when(F.contains(text, F.lit("+")), F.filter(places(text, PHONE, 3), lambda x: F.length(_digits(x["value"])).between(9, 15))).otherwise(none)
    return F.concat(email, ip, card, phone)


def terms(text: Column) -> Column:
    """The distinct terms of a text, in lower case; parts of emails are none."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0)))


def _surroundings(rows: DataFrame) -> DataFrame:
    """key, value, scene: a row for each protected value in a text; scenes tell its surroundings apart."""
    each = rows.select("key", "text", F.explode("base").alias("s"))
    value = F.when(F.col("s.kind") == 0, F.lower("s.value")).otherwise(F.when(F.col("s.kind") == 1, F.col("s.value")).otherwise(_digits(F.col("s.value"))))
    left = F.substring(F.col("text"), F.greatest(F.col("s.start") - AROUND + 1, F.lit(1)), F.least(F.col("s.start"), F.lit(AROUND)))
    right = F.substring(F.col("text"), F.col("s.end") + 1, F.lit(AROUND))
    near = lambda part: F.regexp_extract_all(F.lower(part), F.lit(WORD), F.lit(0))
    around = F.array_distinct(F.concat(F.slice(F.reverse(near(left)), 1, NEAR), F.slice(near(right), 1, NEAR)))
    return each.select("key", F.xxhash64("s.kind", value).alias("value"), F.xxhash64(F.array_sort(around)).alias("scene"))


def _small(table: DataFrame) -> DataFrame:
    """A written table, broadcast where its counted rows allow it."""
    return F.broadcast(table) if table.count() <= SENT else table


def revealing(near: DataFrame, rows: DataFrame, support: int, generalise: float, remove: float) -> DataFrame:
    """value, term, removed: the terms whose disclosure reaches the thresholds, from the surroundings
    ``near`` (key, value, scene) and all texts ``rows`` (key, text, base)."""
    none = near.select("value", F.lit("").alias("term"), F.lit(False).alias("removed")).limit(0)
    n = rows.count()
    scenes = near.select("value", "scene").distinct()
    often = tables.written(scenes.groupBy("value").agg(F.count("*").alias("scenes")).where(F.col("scenes") >= support).select("value"), "pii-values")
    if often.isEmpty():
        return none
    met = near.join(_small(often), "value").groupBy("key").agg(F.collect_set(F.struct("value", "scene")).alias("met"))
    texts = tables.written(rows.where(F.size("base") > 0).select("key", terms(F.col("text")).alias("terms")).join(met, "key").select("met", "terms"), "pii-texts")
    values = F.array_distinct(F.transform("met", lambda m: m["value"]))
    n_v = tables.written(texts.select(F.explode(values).alias("value")).groupBy("value").agg(F.count("*").alias("n_v")), "pii-held")
    each = texts.select("met", "terms", F.explode(values).alias("value"))
    shown = F.size(F.filter("met", lambda m: m["value"] == F.col("value")))
    # Counted on the way into the shuffle; more surroundings than a text shows each time there can't be.
    together = each.select("value", shown.alias("shown"), F.explode("terms").alias("term")).groupBy("value", "term").agg(F.count("*").alias("n_vt"), F.sum("shown").alias("most")).where(F.col("most") >= support).drop("most")
    # A term is in as many texts at least as it is seen in with any value: what that bound rules out
    # (common words above all) needs no counting over the corpus.
    least = texts.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n_t"))
    bits = F.log2(F.lit(float(n)) / F.col("n_v"))
    told = F.log2(F.lit(float(n)) * F.col("n_vt") / (F.col("n_v") * F.col("n_t")))
    share = F.when(bits > 0, told / bits).otherwise(0.0)
    may = tables.written(together.join(_small(n_v), "value").join(least, "term").where(share >= generalise).drop("n_t"), "pii-terms")
    seen = texts.select("terms", F.explode("met").alias("m")).select("m.value", "m.scene", F.explode("terms").alias("term"))
    apart = seen.join(_small(may.select("value", "term")), ["value", "term"]).distinct().groupBy("value", "term").agg(F.count("*").alias("scenes"))
    held = tables.written(may.join(apart.where(F.col("scenes") >= support).select("value", "term"), ["value", "term"]), "pii-judged")
    if held.isEmpty():
        return none
    words = rows.select(F.explode(terms(F.col("text"))).alias("term"))
    n_t = words.groupBy("term").agg(F.count("*").alias("n_t"))  # counted before the shuffle, joined after
    return held.join(n_t, "term").withColumn("share", share).where(F.col("share") >= generalise).select("value", "term", (F.col("share") >= remove).alias("removed"))


def find(docs: DataFrame, support: int = 3, generalise: float = 0.75, remove: float = 0.95) -> DataFrame:
    """``docs`` (text, and any other columns but key, base, added) with ``base``, the spans found by
    form, and ``added``, the places of revealing terms (kind 4 generalised, 5 removed)."""
    none = F.expr(f"cast(array() as {FOUND})")
    rows = docs.withColumn("key", F.xxhash64(*[c for c in ("doc_id", "text") if c in docs.columns])).withColumn("base", base_spans(F.col("text")))
    near = tables.written(_surroundings(rows.select("key", "text", "base")), "pii-near")
    told = tables.written(revealing(near, rows.select("key", "text", "base"), support, generalise, remove), "pii-revealing")
    if told.isEmpty():
        return rows.drop("key").withColumn("added", none)
    by_text = near.select("key", "value").distinct().join(_small(told), "value").groupBy("key").agg(F.collect_set(F.when(~F.col("removed"), F.col("term"))).alias("vague"), F.collect_set(F.when(F.col("removed"), F.col("term"))).alias("gone"))
    some = rows.where(F.size("base") > 0).join(by_text, "key", "left")
    some = some.withColumn("gone", F.array_intersect("gone", terms(F.col("text")))).withColumn("vague", F.array_intersect("vague", terms(F.col("text"))))

    def at(words: str, kind: int) -> Column:
        pattern = F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}@.])(?:"), F.array_join(F.array_sort(words), "|"), F.lit(r")(?![\p{L}\p{N}@])"))
        hits = F.filter(places(F.col("text"), pattern, kind), lambda t: ~F.exists("base", lambda b: (t["start"] < b["end"]) & (b["start"] < t["end"])))
        return F.when(F.size(words) > 0, hits).otherwise(none)

    added = some.withColumn("added", F.concat(at("gone", 5), at("vague", 4))).drop("vague", "gone")
    rest = rows.where(F.size("base") == 0).withColumn("added", none)
    return rest.unionByName(added).drop("key")


def _shown(spans: Column, names: tuple[str, ...]) -> Column:
    listed = F.array(*[F.lit(n) for n in names])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(listed, s["kind"]), s["start"], s["end"])), ",")


def spans(docs: DataFrame, **options: float) -> DataFrame:
    """doc_id, counts by kind, base_sha256 and spans of each document."""
    found = find(tables.texts(docs), **options)
    names = (*KINDS, "term", "term")
    order = F.array_sort(F.transform("added", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    added = F.transform(order, lambda s: F.struct(F.lit(4).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.lit("").alias("value")))
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [(F.size("base") - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(_shown(F.col("base"), names), 256).alias("base_sha256"), _shown(F.concat("base", added), names).alias("spans"))


def sanitise(docs: DataFrame, **options: float) -> DataFrame:
    """``docs``, all columns, with every span of ``text`` replaced by its kind in brackets, revealing
    terms by [TERM] or, from the higher threshold on, by nothing. Overlapping spans go as one."""
    names = F.array(*[F.lit(f"[{n.upper()}]") for n in (*KINDS, "term")], F.lit(""))
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = find(inner, **options)
    order = F.array_sort(F.transform(F.concat("base", "added"), lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("until"), s["kind"].alias("kind"))))
    text = F.col("text")

    def cut(acc: Column, s: Column) -> Column:
        end = -s["until"]
        kept = F.substring(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        mark = F.when(s["start"] >= acc["at"], F.get(names, s["kind"])).otherwise("")
        return F.struct(F.greatest(end, acc["at"]).alias("at"), F.concat(acc["out"], kept, mark).alias("out"))

    clean = F.aggregate(order, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), cut, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    new = F.when(F.col("row.text").isNull(), F.col("row.text")).when(F.size(order) > 0, clean).otherwise(text)
    return found.select(*[new.alias("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
