"""Queries on trust, integrity, extraction, joins and sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recollect.functions import scoring, text
from recollect.operators import knowledge, search
from recollect.sources.views import episodes, supply_edges, table, vectors

from .register import registry

QUERIES, ORACLE, query = registry()
C = F.col


@query("""
SELECT o_orderkey, CAST(round(greatest(0.0, least(1.0, (CASE o_orderpriority WHEN '1-URGENT' THEN 1.0 WHEN '2-HIGH' THEN 0.9 WHEN '3-MEDIUM' THEN 0.7 WHEN '5-LOW' THEN 0.3
 ELSE CASE WHEN o_custkey % 7 >= 5 THEN 0.9 WHEN o_custkey % 7 >= 3 THEN 0.8 WHEN o_custkey % 7 >= 1 THEN 0.6 ELSE 0.4 END END)
 + (CASE WHEN o_custkey % 7 >= 5 THEN 0.1 WHEN o_custkey % 7 >= 3 THEN 0.05 ELSE 0.0 END) - least((o_orderkey % 9)*0.05, 0.3) - least((o_orderkey % 5)*0.1, 0.3))), 6) AS DOUBLE) AS trust FROM orders""")
def trust_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order priorities stand for origins."""
    o = table(spark, sf_dir, "orders")
    p = C("o_orderpriority")
    origin = F.when(p == "1-URGENT", "DirectObservation").when(p == "2-HIGH", "UserProvided").when(p == "3-MEDIUM", "LlmExtraction").when(p == "5-LOW", "DreamReplay").otherwise("Consolidation")
    e = C("o_custkey") % 7
    return o.select("o_orderkey", F.round(knowledge.trust(origin, e, e, C("o_orderkey") % 9, C("o_orderkey") % 5), 6).alias("trust"))


@query("""WITH e AS (SELECT DISTINCT l_partkey AS source, l_suppkey + 1000000 AS target FROM lineitem)
SELECT source, target FROM e WHERE source NOT IN (SELECT p_partkey FROM part WHERE p_size <= 45) OR target NOT IN (SELECT s_suppkey + 1000000 FROM supplier)""")
def integrity_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges with an end among parts that were taken out (over size 45)."""
    parts = table(spark, sf_dir, "part").where("p_size <= 45").select(C("p_partkey").alias("node"))
    suppliers = table(spark, sf_dir, "supplier").select((C("s_suppkey") + 1_000_000).alias("node"))
    return knowledge.orphans(supply_edges(spark, sf_dir).select("source", "target"), parts, suppliers)


@query("SELECT l_orderkey AS chain, count(*) AS n FROM lineitem GROUP BY 1 HAVING min(l_linenumber) <> 1 OR max(l_linenumber) <> count(*) OR count(DISTINCT l_linenumber) <> count(*)")
def integrity_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(C("l_orderkey").alias("chain"), C("l_linenumber").alias("version"))
    return knowledge.broken_chains(rows, "chain", "version")


@query("""WITH c AS (SELECT sha256('m' || chr(31) || text) AS hash, min(length(text)) AS size FROM documents WHERE doc_id % 2 = 0 GROUP BY 1)
SELECT d.doc_id AS id, c.size FROM documents d LEFT JOIN c ON sha256('m' || chr(31) || d.text) = c.hash""")
def embed_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a cache filled from even ids holds for all texts (a text's length stands for its vector)."""
    d = table(spark, sf_dir, "documents").select(C("doc_id").alias("id"), "text")
    cache = d.where("id % 2 = 0").groupBy(F.sha2(F.concat(F.lit("m\x1f"), "text"), 256).alias("hash")).agg(F.min(F.length("text")).cast("long").alias("embedding"))
    return knowledge.cached(d, cache, "m").select("id", C("embedding").alias("size"))


_VERB = "(x IN (" + ", ".join(f"'{v}'" for v in text.VERBS) + ") OR " + " OR ".join(f"(ends_with(x, '{e}') AND octet_length(encode(x)) > {len(e) + 1})" for e in text.VERB_ENDS) + ")"
_MONTH = "coalesce(" + ", ".join(f"CASE WHEN contains(lower(s), '{m}') THEN trim(substring(s, strpos(lower(s), '{m}'), {len(m) + 15})) END" for m in text.MONTHS) + ")"
_RELATIVE = "coalesce(" + ", ".join(f"CASE WHEN contains(lower(s), '{r}') THEN '{r}' END" for r in text.RELATIVE) + ")"
_TRIM = "regexp_replace({0}, '^[^\\p{{L}}\\p{{N}}{1}]+|[^\\p{{L}}\\p{{N}}{1}]+$', '', 'g')"


@query(f"""WITH p AS (SELECT doc_id, string_split_regex(text, '[.!?]') AS parts FROM documents),
s AS (SELECT doc_id, CAST(i - 1 AS INTEGER) AS sentence, parts[i] AS s FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM p)),
w AS (SELECT *, list_filter(regexp_split_to_array(s, '\\s+'), lambda x: x <> '') AS w FROM s),
b AS (SELECT *, list_transform(w, lambda x: {_TRIM.format('x', '')}) AS bare, list_transform(w, lambda x: {_TRIM.format('lower(x)', '')}) AS low FROM w WHERE len(w) >= 3),
f AS (SELECT *, list_filter(bare, lambda x: x <> '' AND (regexp_matches(x, '^\\p{{Lu}}') OR lower(x) NOT IN ({", ".join(f"'{x}'" for x in text.NO_SUBJECT)})))[1] AS subject, list_position(list_transform(low, lambda x: {_VERB}), true) AS k FROM b),
o AS (SELECT *, low[k] AS verb, list_filter(list_transform(list_slice(w, k + 1, len(w)), lambda x: {_TRIM.format('x', '.-')}), lambda x: x <> '') AS rest,
 coalesce({_MONTH}, list_filter(list_transform(w, lambda x: lower(x)), lambda x: regexp_matches(x, '^[0-9]{{4}}-[^-]*-[^-]*$') AND octet_length(encode(x)) >= 8)[1], {_RELATIVE}) AS time FROM f WHERE subject IS NOT NULL AND k > 0)
SELECT doc_id, sentence, subject, verb, array_to_string(rest, ' ') AS object, time, round(CAST(0.6 + CASE WHEN regexp_matches(subject, '^\\p{{Lu}}') THEN 0.1 ELSE 0 END + CASE WHEN octet_length(encode(verb)) > 2 THEN 0.1 ELSE 0 END + CASE WHEN len(rest) >= 2 THEN 0.1 ELSE 0 END AS DOUBLE), 6) AS confidence FROM o WHERE len(rest) > 0""")
def svo_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subject, verb, object and time of every sentence."""
    found = knowledge.clauses(table(spark, sf_dir, "documents"), "doc_id", "text")
    return found.withColumn("confidence", F.round("confidence", 6))


@query("""WITH ep AS (SELECT event_id AS id, least(greatest(value/100, 0.0), 1.0) AS importance, event_id % 7 AS f, (1706745600000 - epoch_us(ts)//1000)/3600000.0 AS age FROM events)
SELECT id, round(importance*0.2, 6) AS part_importance, round(exp(-0.01/(1+importance)/(1+f)*age)*0.2, 6) AS part_recency FROM ep""")
def retrieval_explanation(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = episodes(spark, sf_dir)
    age = (1706745600000 - C("created_ms")) / 3600000.0
    out = knowledge.explained(e, {"importance": C("importance"), "recency": scoring.recency(age, C("importance"), C("access_count"))})
    return out.select("id", F.round("part_importance", 6).alias("part_importance"), F.round("part_recency", 6).alias("part_recency"))


@query("""WITH q AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id % 20 = 0),
s AS (SELECT q.vec_id AS a, x.vec_id AS b, list_cosine_similarity(q.e, CAST(x.embedding AS DOUBLE[])) AS c FROM q JOIN embeddings x ON x.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY c DESC, b) AS k FROM s) SELECT a AS source, b AS target, round(c, 6) AS weight FROM r WHERE k <= 10 AND c >= 0.3""")
def similarity_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges from new vectors to at most ten similar ones each."""
    v = vectors(spark, sf_dir)
    new = v.where(C("id") % 20 == 0).select(C("id").alias("query_id"), C("embedding").alias("query"))
    return search.vector_search_many(v, new, 10).where("score >= 0.3").select(C("query_id").alias("source"), C("id").alias("target"), F.round("score", 6).alias("weight"))


@query("""WITH s AS (SELECT user_id, ts, event_id, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 12 HOUR THEN 1 ELSE 0 END AS edge FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
g AS (SELECT *, sum(edge) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM s)
SELECT user_id, epoch_us(min(ts)) AS start_us, count(*) AS n FROM g GROUP BY user_id, k""")
def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("ts", C("ts").cast("timestamp"))
    g = e.groupBy("user_id", F.session_window("ts", "12 hours").alias("w")).agg(F.count("*").alias("n"))
    return g.select("user_id", F.unix_micros("w.start").alias("start_us"), "n")


@query("""WITH o AS (SELECT o_custkey, o_orderdate, o_orderkey FROM orders), l AS (SELECT e.event_id, e.user_id, e.ts, o.o_orderkey, row_number() OVER (PARTITION BY e.event_id ORDER BY o.o_orderdate DESC, o.o_orderkey DESC) AS r
FROM events e JOIN o ON o.o_custkey = e.user_id AND o.o_orderdate <= e.ts - INTERVAL 20 YEAR) SELECT event_id, o_orderkey FROM l WHERE r = 1
UNION ALL SELECT event_id, NULL FROM events WHERE event_id NOT IN (SELECT event_id FROM l)""")
def as_of_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last order of each event's user, twenty years before it: both sides in one sort by user and
    time, so a user's rows meet once, not in pairs."""
    e = table(spark, sf_dir, "events").select("event_id", C("user_id").alias("k"), (C("ts") - F.expr("INTERVAL 20 YEARS")).alias("t"), F.lit(None).cast("long").alias("o_orderkey"), F.lit(1).alias("side"))
    o = table(spark, sf_dir, "orders").select(F.lit(None).cast("long").alias("event_id"), C("o_custkey").alias("k"), C("o_orderdate").cast(e.schema["t"].dataType).alias("t"), "o_orderkey", F.lit(0).alias("side"))
    w = Window.partitionBy("k").orderBy("t", "side", "o_orderkey").rowsBetween(Window.unboundedPreceding, 0)
    return e.unionByName(o).withColumn("last", F.last("o_orderkey", ignorenulls=True).over(w)).where("side = 1").select("event_id", C("last").alias("o_orderkey"))


@query("SELECT n_name, r_name, count(*) AS customers, round(avg(c_acctbal), 4) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)")
def rollup_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), C("c_nationkey") == C("n_nationkey")).join(table(spark, sf_dir, "region"), C("n_regionkey") == C("r_regionkey"))
    return j.rollup("r_name", "n_name").agg(F.count("*").alias("customers"), F.round(F.avg("c_acctbal"), 4).alias("balance")).select("n_name", "r_name", "customers", "balance")


@query("(SELECT l_partkey AS id FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_partkey FROM lineitem WHERE l_linestatus = 'O') EXCEPT SELECT p_partkey FROM part WHERE p_size < 10")
def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    a = li.where("l_returnflag = 'R'").select(C("l_partkey").alias("id"))
    return a.intersect(li.where("l_linestatus = 'O'").select("l_partkey")).subtract(table(spark, sf_dir, "part").where("p_size < 10").select("p_partkey"))


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").where("o_totalprice > 300000").select(C("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(o, "c_custkey", "left_anti").select("c_custkey")


@query("""SELECT event_id, CAST(json_object('id', event_id, 'type', event_type) AS VARCHAR) AS record FROM events""")
def json_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.to_json(F.struct(C("event_id").alias("id"), C("event_type").alias("type"))).alias("record"))
