"""Records about records: trust, provenance, integrity, extraction and summaries."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollect.functions import scoring, text

# Trust by origin, before bonuses and penalties.
ORIGIN_BASE = {"DirectObservation": 1.0, "UserProvided": 0.9, "LlmExtraction": 0.7, "CrossAgent": 0.6, "DreamReplay": 0.3}


def trust(origin: Column, evidence: Column, sources: Column, unsupported: Column, contradictions: Column) -> Column:
    """Trust of a record: its origin, more for diverse sources, less for unsupported changes and
    contradictions, in 0 .. 1. A consolidated record's base goes by its evidence."""
    base = F.when(evidence >= 5, 0.9).when(evidence >= 3, 0.8).when(evidence >= 1, 0.6).otherwise(0.4)
    for name, value in ORIGIN_BASE.items():
        base = F.when(origin == name, value).otherwise(base)
    bonus = F.when(sources >= 5, 0.1).when(sources >= 3, 0.05).otherwise(0.0)
    return scoring.clamp(base + bonus - F.least(unsupported * 0.05, F.lit(0.3)) - F.least(contradictions * 0.1, F.lit(0.3)))


def orphans(edges: DataFrame, nodes: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """source, target of edges with an end that isn't a node; with ``targets``, for two kinds of nodes
    whose ids may coincide, sources are looked up in ``nodes`` and targets in those."""
    s = nodes.select(F.col("node").alias("source"))
    t = (nodes if targets is None else targets).select(F.col("node").alias("target"))
    a = edges.join(s, "source", "left_anti").select("source", "target")
    b = edges.join(t, "target", "left_anti").select("source", "target")
    return a.unionByName(b).distinct()


def broken_chains(revisions: DataFrame, chain: str, version: str) -> DataFrame:
    """Chains whose versions aren't 1 .. n."""
    g = revisions.groupBy(chain).agg(F.count("*").alias("n"), F.min(version).alias("lo"), F.max(version).alias("hi"), F.count_distinct(version).alias("d"))
    return g.where((F.col("lo") != 1) | (F.col("hi") != F.col("n")) | (F.col("d") != F.col("n"))).select(chain, "n")


def cached(texts: DataFrame, cache: DataFrame, model: str) -> DataFrame:
    """``texts`` (id, text) with the vector that the cache holds for (model, text), null where none."""
    key = F.sha2(F.concat(F.lit(model + "\x1f"), F.col("text")), 256)
    return texts.withColumn("hash", key).join(cache.select("hash", "embedding"), "hash", "left").drop("hash")


def expand_terms(found: DataFrame, seen: list[str], top: int = 4) -> list[str]:
    """The terms that a next search round adds: of the found rows (text, score; a short list), those
    with the most score over the root of how many rows have them."""
    terms = found.select(F.explode(text.lexical_terms(F.col("text"))).alias("term"), F.greatest("score", F.lit(0.05)).alias("s"))
    ranked = terms.where(~F.col("term").isin(*seen)) if seen else terms
    return [r["term"] for r in ranked.groupBy("term").agg((F.sum("s") / F.sqrt(F.count("*"))).alias("w")).orderBy(F.desc("w"), "term").limit(top).collect()]


def clauses(rows: DataFrame, id: str, content: str, least_confidence: float = 0.0) -> DataFrame:
    """id, sentence (from 0), subject, verb, object, time, confidence of each sentence of three words
    or more that has all of the first three: the first word that may be a subject, the first that is
    or ends as a verb, and what follows it; ``time`` is a date or time word of the sentence, or null."""
    # Everything is computed once for a sentence: fields of a struct in an array, which filters can't be
    # moved below, and words are trimmed together, joined by blanks, so that they keep their places.
    bare = lambda words, kept="": F.split(F.regexp_replace(words, rf"(?<![^ ])[^\p{{L}}\p{{N}} {kept}]++|(?<=[\p{{L}}\p{{N}}{kept}])[^\p{{L}}\p{{N}} {kept}]++(?![^ ])", ""), " ", -1)
    ends = lambda w: reduce(lambda x, y: x | y, [F.endswith(w, F.lit(e)) & (F.octet_length(w) > len(e) + 1) for e in text.VERB_ENDS])
    subjects = lambda words: F.get(F.filter(words, lambda b: (b != "") & (b.rlike(r"^\p{Lu}") | ~F.lower(b).isin(*text.NO_SUBJECT))), F.lit(0))

    def more(found: Column, **fields: Callable[[Column], Column]) -> Column:
        """The structs of an array with fields added."""
        return F.transform(found, lambda x: reduce(lambda made, f: made.withField(f[0], f[1](x)), fields.items(), x))

    def time(x: Column) -> Column:
        month = F.coalesce(*[F.when(F.contains(x["small"], F.lit(m)), F.trim(F.substring(x["s"], F.instr(x["small"], m), F.lit(len(m) + 15)))) for m in text.MONTHS])
        dates = F.filter(F.transform(x["w"], F.lower), lambda w: w.rlike(r"^[0-9]{4}-[^-]*-[^-]*$") & (F.octet_length(w) >= 8))
        relative = F.coalesce(*[F.when(F.contains(x["small"], F.lit(r)), F.lit(r)) for r in text.RELATIVE])
        return F.coalesce(month, F.when(x["s"].rlike("[0-9]{4}-"), F.get(dates, F.lit(0))), relative)

    each = rows.select(id, F.posexplode(F.split(content, "[.!?]")).alias("sentence", "s"))
    found = F.filter(F.transform(F.array("s"), lambda s: F.struct(s.alias("s"), text.split_words(s).alias("w"))), lambda x: F.size(x["w"]) >= 3)
    found = more(found, j=lambda x: F.array_join(x["w"], " "))
    found = more(found, low=lambda x: bare(F.lower(x["j"])))
    found = F.filter(more(found, at=lambda x: F.array_position(F.transform(x["low"], lambda w: w.isin(*text.VERBS) | ends(w)), True).cast("int")), lambda x: x["at"] > 0)
    found = more(found, bare=lambda x: bare(x["j"]))
    # The subject is mostly one of the first words; only where it isn't are all words looked at.
    found = F.filter(more(found, subject=lambda x: F.coalesce(subjects(F.slice(x["bare"], 1, 3)), subjects(x["bare"]))), lambda x: x["subject"].isNotNull())
    found = F.filter(more(found, rest=lambda x: F.filter(bare(F.array_join(F.slice(x["w"], x["at"] + 1, F.size(x["w"])), " "), ".-"), lambda w: w != "")), lambda x: F.size(x["rest"]) > 0)
    found = more(found, small=lambda x: F.lower(x["s"]))
    found = F.transform(found, lambda x: F.struct(x["subject"].alias("subject"), F.element_at(x["low"], x["at"]).alias("verb"), F.array_join(x["rest"], " ").alias("object"), time(x).alias("time"), (F.size(x["rest"]) >= 2).alias("long")))
    # The outer form: for a plain explode the optimiser adds a filter that computes the array again.
    made = each.select(id, "sentence", F.explode_outer(found).alias("c")).where(F.col("c").isNotNull()).select(id, "sentence", "c.*")
    confidence = 0.6 + F.when(F.col("subject").rlike(r"^\p{Lu}"), 0.1).otherwise(0.0) + F.when(F.octet_length("verb") > 2, 0.1).otherwise(0.0) + F.when(F.col("long"), 0.1).otherwise(0.0)
    return made.select(id, "sentence", "subject", "verb", "object", "time", confidence.alias("confidence")).where(F.col("confidence") >= least_confidence)


def explained(rows: DataFrame, terms: dict[str, Column]) -> DataFrame:
    """``rows`` with each term's part in the recall score."""
    return rows.withColumns({f"part_{k}": scoring.clamp(v) * scoring.RECALL_WEIGHTS[k] for k, v in terms.items()})
