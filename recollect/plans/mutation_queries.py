"""Mutations, admission and retrieval as a whole. Orders of a customer stand for revisions of a memory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recollect.functions import scoring, text
from recollect.operators import admission, graph, lifecycle, recall, revisions, search
from recollect.sources.settled import settled
from recollect.sources.views import episodes, supply_edges, table, vectors

from .register import registry

QUERIES, ORACLE, query = registry()
C = F.col
REV = """WITH rev AS (SELECT o_custkey AS chain, row_number() OVER w AS version, CASE WHEN lead(o_orderkey) OVER w IS NULL THEN 'Active' ELSE 'Superseded' END AS state, o_orderdate AS valid_from,
 lead(o_orderdate) OVER w AS valid_until, o_totalprice AS value FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
h AS (SELECT * FROM rev WHERE state = 'Active')"""
SHOWN = "chain, version, state, epoch_us(valid_from) AS from_us, epoch_us(valid_until) AS until_us, round(value, 2) AS value"
AT = "TIMESTAMP '1999-01-01'"
_Q = "(SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = {})"


def _revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, w = table(spark, sf_dir, "orders"), Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    last = F.lead("o_orderdate").over(w)
    made = o.select(C("o_custkey").alias("chain"), F.row_number().over(w).cast("long").alias("version"), F.when(last.isNull(), revisions.LIVE).otherwise(revisions.SUPERSEDED).alias("state"), C("o_orderdate").alias("valid_from"), last.alias("valid_until"), C("o_totalprice").alias("value"))
    return settled(made, "revisions")


def _shown(rows: DataFrame, *more: str) -> DataFrame:
    us = lambda c: F.unix_micros(C(c).cast("timestamp"))
    return rows.select("chain", "version", "state", us("valid_from").alias("from_us"), us("valid_until").alias("until_us"), F.round("value", 2).alias("value"), *more)


def _at(rows: DataFrame):
    return F.lit("1999-01-01 00:00:00").cast(rows.schema["valid_from"].dataType)


def _closed(which: str, closed: str, extra: str = "") -> str:
    return f"SELECT chain, version, CASE WHEN state = 'Active' AND {which} THEN '{closed}' ELSE state END AS state, valid_from, CASE WHEN state = 'Active' AND {which} THEN {AT} ELSE valid_until END AS valid_until, value{extra} FROM rev"


@query(REV + f", x AS ({_closed('chain % 10 = 0', 'Superseded')} UNION ALL SELECT chain, version + 1, 'Active', {AT}, NULL, value + 100 FROM h WHERE chain % 10 = 0) SELECT {SHOWN} FROM x")
def correct_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth chain gets a corrected value as its next revision."""
    r = _revisions(spark, sf_dir)
    changes = revisions.heads(r).where("chain % 10 = 0").select("chain", (C("value") + 100).alias("value"))
    return _shown(revisions.successor(r, changes, _at(r)))


@query(REV + f", x AS ({_closed('chain % 7 = 3', 'Superseded')} UNION ALL SELECT chain, version + 1, 'Retracted', {AT}, NULL, value FROM h WHERE chain % 7 = 3) SELECT {SHOWN} FROM x")
def retract_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh chain ends in a tombstone."""
    r = _revisions(spark, sf_dir)
    return _shown(revisions.retract(r, r.where("chain % 7 = 3").select("chain").distinct(), _at(r)))


_PAIRS = "p AS (SELECT s.chain AS source, t.chain AS target FROM h s JOIN h t ON t.chain = s.chain + 1 WHERE s.chain % 10 = 1)"


@query(REV + f", {_PAIRS}, x AS ({_closed('chain IN (SELECT source FROM p)', 'Superseded', ', NULL AS merged_into')} UNION ALL SELECT chain, version + 1, 'Merged', {AT}, NULL, value, p.target FROM h JOIN p ON p.source = h.chain) SELECT {SHOWN}, merged_into FROM x")
def merge_memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth chain is merged into the next one."""
    r = _revisions(spark, sf_dir)
    pairs = r.where("chain % 10 = 1").select(C("chain").alias("source"), (C("chain") + 1).alias("target")).distinct()
    return _shown(revisions.merge(r, pairs, _at(r))[0], "merged_into")


@query(REV + f", {_PAIRS} SELECT target AS source, source AS target, 'DerivedFrom' AS relation, CAST(1.0 AS DOUBLE) AS weight FROM p")
def merge_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What merged memories derive from."""
    r = _revisions(spark, sf_dir)
    pairs = r.where("chain % 10 = 1").select(C("chain").alias("source"), (C("chain") + 1).alias("target")).distinct()
    return revisions.merge(r, pairs, _at(r))[1]


@query("SELECT min(c_custkey) AS id, c_nationkey AS agent, c_mktsegment AS concept FROM customer WHERE c_custkey % 3 = 0 GROUP BY 2, 3 UNION ALL SELECT min(c_custkey), c_nationkey, c_mktsegment FROM customer WHERE c_custkey % 3 <> 0 AND (c_nationkey, c_mktsegment) NOT IN (SELECT (c_nationkey, c_mktsegment) FROM customer WHERE c_custkey % 3 = 0) GROUP BY 2, 3")
def store_semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concepts are unique by agent: a new one is stored only where there is none."""
    c = table(spark, sf_dir, "customer").select(C("c_custkey").alias("id"), C("c_nationkey").alias("agent"), C("c_mktsegment").alias("concept"))
    stored = revisions.store_unique(c.limit(0), c.where("id % 3 = 0"), ["agent", "concept"], "id")
    return revisions.store_unique(stored, c.where("id % 3 <> 0"), ["agent", "concept"], "id")


@query("""WITH e AS (SELECT l_partkey AS source, l_suppkey + 1000000 AS target, 'Supports' AS relation, max(l_discount*10) AS weight FROM lineitem GROUP BY 1, 2),
old AS (SELECT * FROM e WHERE target % 2 = 0), new AS (SELECT source, target, relation, greatest(least(weight*2, 1.0), 0.0) AS weight FROM e WHERE target % 2 = 1),
r AS (SELECT n.*, row_number() OVER (PARTITION BY source ORDER BY weight DESC, target) + coalesce((SELECT count(*) FROM old WHERE old.source = n.source), 0) AS k FROM new n)
SELECT source, target, relation, round(weight, 6) AS weight FROM old UNION ALL SELECT source, target, relation, round(weight, 6) FROM r WHERE k <= 5""")
def connect_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed, weighted edges are added, at most five to a node in all."""
    e = table(spark, sf_dir, "lineitem").groupBy(C("l_partkey").alias("source"), (C("l_suppkey") + 1_000_000).alias("target"), F.lit("Supports").alias("relation")).agg(F.max(C("l_discount") * 10).alias("weight"))
    e = settled(e, "edges")
    out = revisions.connect(e.where("target % 2 = 0"), e.where("target % 2 = 1").withColumn("weight", C("weight") * 2), 5)
    return out.withColumn("weight", F.round("weight", 6))


@query("SELECT DISTINCT l_partkey AS source, l_suppkey + 1000000 AS target FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size % 5 = 0)")
def purge_agent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges left when an agent (parts of every fifth size) is purged."""
    p = table(spark, sf_dir, "part")
    return revisions.purge_agent(p, supply_edges(spark, sf_dir).select("source", "target"), C("p_size") % 5 == 0, "p_partkey", ("source",))[1]


@query("""WITH s AS (SELECT q.vec_id AS id, min(1 - list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(x.embedding AS DOUBLE[]))) AS d FROM embeddings q JOIN embeddings x ON q.vec_id % 20 = 0 AND x.vec_id <> q.vec_id GROUP BY 1)
SELECT id, round(d, 6) AS distance, CASE WHEN d <= 1 - 0.95 OR d < 0.3 THEN 'reject' ELSE 'accept' END AS decision, CASE WHEN d <= 1 - 0.95 THEN 'duplicate' WHEN d < 0.3 THEN 'surprise' ELSE 'none' END AS decided_by,
round(CASE WHEN d >= 0.3 THEN greatest(0.0, least(1.0, d)) END, 6) AS importance_override FROM s""")
def admission_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New vectors (every twentieth) pass the duplicate gate, then the surprise gate."""
    v = vectors(spark, sf_dir).select("id", "embedding")
    near = admission.nearest(v.where("id % 20 = 0"), v)
    surprise, importance = admission.surprise_gate(C("distance"))
    out = admission.admitted(near, [("duplicate", admission.duplicate_gate(C("distance")), None), ("surprise", surprise, importance)])
    return out.select("id", F.round("distance", 6).alias("distance"), "decision", "decided_by", F.round("importance_override", 6).alias("importance_override"))


@query(f"""WITH s AS (SELECT vec_id AS id, label, greatest(0.0, least(1.0, list_cosine_similarity(CAST(embedding AS DOUBLE[]), {_Q.format(5)}))) AS sim FROM embeddings ORDER BY sim DESC, id LIMIT 218),
f AS (SELECT *, 0.6*sim + 0.4*((id % 10)/10.0) AS score FROM s WHERE label % 2 = 0 AND id % 9 <> 4), p AS (SELECT *, row_number() OVER (ORDER BY sim DESC, id) AS r FROM f),
i AS (SELECT a.id, a.sim, CASE WHEN a.sim >= 0.2 AND EXISTS (SELECT 1 FROM p b WHERE b.r < a.r AND b.r >= a.r - 20 AND b.sim >= 0.2 AND abs(b.sim - a.sim) < 0.001) THEN a.score*0.5 ELSE a.score END AS score FROM p a)
SELECT id, round(sim, 6) AS similarity, round(score, 6) AS score FROM i ORDER BY i.score DESC, i.sim DESC, id LIMIT 30""")
def recall_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search, score, filter, live heads, inhibition and limit in their order of effects."""
    v = vectors(spark, sf_dir)
    target = v.where("id = 5").first()["embedding"]
    score = 0.6 * C("similarity") + 0.4 * ((C("id") % 10) / F.lit(10.0))
    even = F.substring("namespace", 3, 9).cast("int") % 2 == 0
    out = recall.recall(v, target, 30, score, even, v.where("id % 9 <> 4").select("id"), (0.2, 0.001))
    return out.select("id", F.round("similarity", 6).alias("similarity"), F.round("score", 6).alias("score"))


@query("SELECT conv_id, turn FROM conversations WHERE len(list_intersect(list_transform(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w), ['the', 'de', 'und'])) > 0")
def involving_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns that involve any of three words."""
    t = table(spark, sf_dir, "conversations")
    return t.where(recall.involving(text.words(C("text")), ["the", "de", "und"])).select("conv_id", "turn")


@query("SELECT event_id FROM events WHERE epoch_us(ts) // 1000 BETWEEN 1706745600000 - 7*86400000 AND 1706745600000")
def temporal_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of "last week", seen from the first of February."""
    low, high = recall.window_of("what happened last week", 1706745600000)
    return episodes(spark, sf_dir).where(C("created_ms").between(low, high)).select(C("id").alias("event_id"))


@query("SELECT event_id FROM events WHERE user_id IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 95)")
def topic_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of users that have the topic of large purchases."""
    e = table(spark, sf_dir, "events").select("event_id", C("user_id").alias("id"))
    topics = table(spark, sf_dir, "events").where("event_type = 'purchase' AND value > 95").select(C("user_id").alias("id"), F.lit("large").alias("topic"))
    return recall.on_topic(e, topics, "large").select("event_id")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE abs(l_discount - 0.05) < 1e-6")
def measured_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").where(recall.equal(C("l_discount"), 0.05)).select("l_orderkey", "l_linenumber")


@query()
def iterative_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full-text rounds that add terms of what they found; tested against a plain loop."""
    d = table(spark, sf_dir, "documents").select(C("doc_id").alias("id"), "text")
    return recall.iterative(d, ["error", "license"], 50).select("id", "round", F.round("score", 6).alias("score"))


@query(f"""WITH e AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), f AS (SELECT label, min(id) AS id FROM e GROUP BY 1),
su AS (SELECT id, 1 AS level, [x.label] AS labels FROM f x UNION ALL SELECT min(id) + 1, 2, list(label) FROM f GROUP BY label % 3),
s AS (SELECT su.id, level, labels, list_cosine_similarity(e.v, {_Q.format(1)}) AS score FROM su JOIN e ON e.id = su.id),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY level ORDER BY score DESC, id) AS k FROM s WHERE score >= -0.2) WHERE k <= 3)
SELECT id, round(score, 6) AS score, level FROM b UNION ALL SELECT e.id, round(max(b.score)*0.8, 6), 0 FROM e JOIN b ON list_contains(b.labels, e.label) WHERE e.id NOT IN (SELECT id FROM su) GROUP BY 1""")
def summary_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two levels of summaries: a vector for each label, and one for each third of the labels."""
    e = table(spark, sf_dir, "embeddings").select(C("vec_id").alias("id"), "label", "embedding")
    one = e.groupBy("label").agg(F.min("id").alias("id")).withColumn("level", F.lit(1))
    two = one.groupBy((C("label") % 3).alias("third")).agg((F.min("id") + 1).alias("id")).withColumn("level", F.lit(2))
    members = e.select(C("id").alias("member"), "label")
    m1 = one.join(members, "label").groupBy("id", "level").agg(F.collect_list("member").alias("members"))
    m2 = two.join(members.withColumn("third", C("label") % 3), "third").groupBy("id", "level").agg(F.collect_list("member").alias("members"))
    summaries = settled(m1.unionByName(m2).join(e.select("id", "embedding"), "id"), "summaries")
    target = e.where("id = 1").first()["embedding"]
    return recall.levels(e.select("id"), summaries, target, 3, -0.2).select("id", F.round("score", 6).alias("score"), "level")


_GROUPS = """WITH RECURSIVE r AS (SELECT o_orderkey AS id, o_custkey AS c, o_totalprice/600000 AS support, (o_orderkey % 10)/10.0 AS recency, (o_custkey % 4)/4.0 AS reliability, o_orderstatus = 'P' AS overridden FROM orders WHERE o_orderpriority = '1-URGENT'),
x AS (SELECT id AS a, lead(id) OVER (PARTITION BY c ORDER BY id) AS b FROM r), e AS (SELECT a, b FROM x WHERE b IS NOT NULL), k AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
g AS (SELECT a AS id, a AS grp FROM k UNION SELECT k.a, g.grp FROM k JOIN g ON k.b = g.id WHERE g.grp < k.a), m AS (SELECT id, min(grp) AS grp FROM g GROUP BY 1),
p AS (SELECT r.id, grp, 0.20*recency + 0.35*reliability + 0.30*support + 0.15*CASE WHEN overridden THEN 1 ELSE 0 END AS pref FROM r JOIN m USING (id))"""


@query(_GROUPS + ' SELECT id, grp AS "group", round(pref, 6) AS preference, row_number() OVER (PARTITION BY grp ORDER BY pref DESC, id) = 1 AS preferred FROM p')
def conflict_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Urgent orders of a customer contradict each other in turn; one of each group is preferred."""
    o = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'")
    r = o.select(C("o_orderkey").alias("id"), "o_custkey", (C("o_totalprice") / 600000).alias("support"), ((C("o_orderkey") % 10) / 10.0).alias("recency"), ((C("o_custkey") % 4) / 4.0).alias("reliability"), (C("o_orderstatus") == "P").alias("overridden"))
    edges = r.select(C("id").alias("source"), F.lead("id").over(Window.partitionBy("o_custkey").orderBy("id")).alias("target")).where("target IS NOT NULL")
    return recall.conflict_groups(r, edges).select("id", "group", F.round("preference", 6).alias("preference"), "preferred")


@query("""WITH d AS (SELECT doc_id AS id, CASE doc_id % 3 WHEN 0 THEN 'direct' WHEN 1 THEN 'graph' ELSE 'causal' END AS section, (doc_id % 100)/100.0 AS score, 0.5 + (doc_id % 7)/14.0 AS trust, CAST(ceil(octet_length(encode(text))/4.0) AS BIGINT) AS tokens FROM documents),
c AS (SELECT *, CASE WHEN score >= 0.6 THEN 'full' WHEN score >= 0.3 THEN 'summary' ELSE 'entities' END AS rendering, CASE WHEN score >= 0.6 THEN tokens WHEN score >= 0.3 THEN tokens // 4 ELSE tokens // 10 END AS spent FROM d),
u AS (SELECT *, sum(spent) OVER (PARTITION BY section ORDER BY score*trust DESC, id ROWS UNBOUNDED PRECEDING) AS upto FROM c)
SELECT id, section, rendering, spent FROM u WHERE upto <= 20000*CASE section WHEN 'direct' THEN 0.5 WHEN 'graph' THEN 0.25 ELSE 0.15 END""")
def context_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as results of three kinds, within their parts of a budget of 20,000 tokens."""
    d = table(spark, sf_dir, "documents")
    section = F.when(C("doc_id") % 3 == 0, "direct").when(C("doc_id") % 3 == 1, "graph").otherwise("causal")
    tokens = scoring.token_count(C("text")).cast("long")
    rows = d.select(C("doc_id").alias("id"), section.alias("section"), ((C("doc_id") % 100) / 100.0).alias("score"), (0.5 + (C("doc_id") % 7) / 14.0).alias("trust"), tokens.alias("tokens"))
    rows = rows.withColumns({"summary_tokens": F.expr("tokens div 4"), "entity_tokens": F.expr("tokens div 10")})
    return recall.assemble(rows, 20_000).select("id", "section", "rendering", "spent")


@query("""WITH RECURSIVE sums AS (SELECT l_partkey AS p, l_suppkey AS s, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2), e AS (SELECT p AS source, s + 1000000 AS target, q/(SELECT max(q) FROM sums) AS weight FROM sums),
seed AS (SELECT p_partkey AS node FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 10),
a AS (SELECT node, CAST(1.0 AS DOUBLE) AS score FROM seed UNION ALL SELECT target, max(weight) FROM e JOIN seed ON source = node GROUP BY 1)
SELECT s_suppkey + 1000000 AS node, s_name AS name, round(max(score), 6) AS activation_score FROM a JOIN supplier ON s_suppkey + 1000000 = node GROUP BY 1, 2""")
def graph_activation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the ten dearest parts activate, hydrated from the suppliers' records."""
    seeds = table(spark, sf_dir, "part").select(C("p_partkey").alias("node"), C("p_retailprice").alias("score"))
    records = table(spark, sf_dir, "supplier").select((C("s_suppkey") + 1_000_000).alias("node"), C("s_name").alias("name"))
    edges = settled(supply_edges(spark, sf_dir).select("source", "target", "weight"), "edges")
    return graph.activate(edges, seeds, records, "static").select("node", "name", F.round("activation_score", 6).alias("activation_score"))


@query("""WITH e AS (SELECT DISTINCT l_partkey AS source, l_suppkey + 1000000 AS target FROM lineitem) SELECT source, target FROM e WHERE source IN (SELECT p_partkey FROM part WHERE p_size < 20) AND target % 3 = 0""")
def induced_subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between small parts and every third supplier."""
    parts = table(spark, sf_dir, "part").where("p_size < 20").select(C("p_partkey").alias("node"))
    suppliers = table(spark, sf_dir, "lineitem").select((C("l_suppkey") + 1_000_000).alias("node")).where("node % 3 = 0").distinct()
    return graph.subgraph(supply_edges(spark, sf_dir).select("source", "target"), parts, suppliers)


@query("""WITH e AS (SELECT DISTINCT l_partkey AS a, l_suppkey + 1000000 AS b FROM lineitem), k AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e), f AS (SELECT p_partkey AS node, (p_partkey % 50 + 1)/100.0 AS score FROM part WHERE p_partkey % 40 = 7),
b AS (SELECT greatest(0.5*min(score), 0.01) AS base FROM f), d1 AS (SELECT DISTINCT b AS node FROM k JOIN f ON a = node WHERE b NOT IN (SELECT node FROM f)),
d2 AS (SELECT DISTINCT k.b AS node FROM k JOIN d1 ON a = node WHERE k.b NOT IN (SELECT node FROM f) AND k.b NOT IN (SELECT node FROM d1))
SELECT node, round(CAST(base/2 AS DOUBLE), 6) AS score, 0 AS level FROM d1, b UNION ALL SELECT node, round(CAST(base/3 AS DOUBLE), 6), 1 FROM d2, b""")
def with_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What some parts derive from within two steps."""
    e = settled(supply_edges(spark, sf_dir).select("source", "target"), "edges")
    both = e.unionByName(e.select(C("target").alias("source"), C("source").alias("target")))
    found = table(spark, sf_dir, "part").where("p_partkey % 40 = 7").select(C("p_partkey").alias("node"), ((C("p_partkey") % 50 + 1) / 100.0).alias("score"))
    return graph.provenance(found, both, 2).select("node", F.round("score", 6).alias("score"), "level")


@query("SELECT event_id AS id, round(CASE WHEN epoch_us(ts) // 1000 < 1706745600000 - 864000000 THEN value*0.95 ELSE value END, 6) AS value FROM events WHERE value > 0 AND NOT (epoch_us(ts) // 1000 + (event_id % 5)*432000000 <= 1706745600000 AND event_id % 5 > 0)")
def decay_and_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows past their time to live go; values not read for ten days fade."""
    e = episodes(spark, sf_dir).where("value > 0").withColumn("ttl", F.when(C("id") % 5 > 0, (C("id") % 5) * 432_000))
    kept = e.where(~lifecycle.expired(e, "created_ms", "ttl", 1706745600000))
    return lifecycle.decay_sweep(kept, "created_ms", "value", 1706745600000, 864_000).select("id", F.round("value", 6).alias("value"))


@query("SELECT r_regionkey || ',' || r_name AS record FROM region")
def csv_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recall.to_csv(table(spark, sf_dir, "region").select("r_regionkey", "r_name"))
