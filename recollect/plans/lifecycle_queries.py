"""Filters, aggregates, windows, revisions and writes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recollect.functions import scoring, text
from recollect.operators import lifecycle
from recollect.sources.views import episodes, table

from .register import registry

QUERIES, ORACLE, query = registry()
C = F.col
EPISODES = "WITH ep AS (SELECT event_id AS id, user_id AS agent_id, event_type AS namespace, epoch_us(ts) // 1000 AS created_ms, least(greatest(value/100, 0.0), 1.0) AS importance, event_id % 7 AS access_count, value, props FROM events)"
WALK = EPISODES.replace("WITH ep", "WITH RECURSIVE ep", 1)


@query("SELECT event_id, user_id, event_type, value FROM events WHERE event_type IN ('click', 'purchase') AND value >= 20 AND (user_id < 50 OR value > 90) ORDER BY value DESC, event_id LIMIT 50 OFFSET 10")
def scan_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filter, sort, project, offset and limit, pushed to the scan as far as Parquet goes."""
    e = table(spark, sf_dir, "events")
    return e.where(C("event_type").isin("click", "purchase") & (C("value") >= 20) & ((C("user_id") < 50) | (C("value") > 90))).orderBy(F.desc("value"), "event_id").offset(10).limit(50).select("event_id", "user_id", "event_type", "value")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_partkey = 7 OR l_suppkey = 7")
def scan_either_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").where((C("l_partkey") == 7) | (C("l_suppkey") == 7)).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query(EPISODES + " SELECT id, created_ms FROM ep WHERE created_ms BETWEEN 1704844800000 AND 1705276800000")
def temporal_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    return episodes(spark, sf_dir).where(C("created_ms").between(1704844800000, 1705276800000)).select("id", "created_ms")


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY' AND c_acctbal > 5000)")
def where_in_subquery(spark: SparkSession, sf_dir: str) -> DataFrame:
    inner = table(spark, sf_dir, "customer").where((C("c_mktsegment") == "MACHINERY") & (C("c_acctbal") > 5000)).select(C("c_custkey").alias("o_custkey"))
    return table(spark, sf_dir, "orders").join(inner, "o_custkey", "left_semi").select("o_orderkey")


@query(EPISODES + " SELECT namespace, count(*) AS n, round(avg(importance), 6) AS avg_importance, round(sum(importance), 4) AS sum_importance, round(min(importance), 6) AS lo, round(max(importance), 6) AS hi FROM ep GROUP BY namespace")
def group_by_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aggregates of importance by key, whatever the key."""
    i = C("importance")
    return episodes(spark, sf_dir).groupBy("namespace").agg(F.count("*").alias("n"), F.round(F.avg(i), 6).alias("avg_importance"), F.round(F.sum(i), 4).alias("sum_importance"), F.round(F.min(i), 6).alias("lo"), F.round(F.max(i), 6).alias("hi"))


@query(EPISODES + ", top AS (SELECT * FROM ep ORDER BY importance DESC, id LIMIT 100) SELECT namespace, count(*) AS n, round(avg(importance), 6) AS avg_importance FROM top GROUP BY namespace")
def group_after_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of a recall's top rows: the limit comes before the grouping."""
    top = episodes(spark, sf_dir).orderBy(F.desc("importance"), "id").limit(100)
    return top.groupBy("namespace").agg(F.count("*").alias("n"), F.round(F.avg("importance"), 6).alias("avg_importance"))


@query("SELECT 'episodic' AS layer, count(*) AS n FROM events UNION ALL SELECT 'semantic', count(*) FROM documents UNION ALL SELECT 'procedural', count(*) FROM part UNION ALL SELECT 'working', count(*) FROM conversations")
def layer_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [table(spark, sf_dir, t).agg(F.lit(layer).alias("layer"), F.count("*").alias("n")) for layer, t in (("episodic", "events"), ("semantic", "documents"), ("procedural", "part"), ("working", "conversations"))]
    from functools import reduce

    return reduce(DataFrame.unionByName, parts)


@query("SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(var_samp(value), 4) AS variance FROM events GROUP BY event_type")
def population_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moments of two halves, merged."""
    e = table(spark, sf_dir, "events")
    halves = [lifecycle.welford(e.where(C("event_id") % 2 == r), "event_type", "value") for r in (0, 1)]
    m = lifecycle.merge_welford(*halves, "event_type")
    return m.select("event_type", "n", F.round("mean", 6).alias("mean"), F.round(C("m2") / (C("n") - 1), 4).alias("variance"))


REVISIONS = "WITH rev AS (SELECT o_custkey AS chain, o_orderkey AS rev_id, o_orderdate AS recorded, o_totalprice AS value, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS version FROM orders)"


def _revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a customer as revisions of one memory."""
    o = table(spark, sf_dir, "orders")
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return o.select(C("o_custkey").alias("chain"), C("o_orderkey").alias("rev_id"), C("o_orderdate").alias("recorded"), C("o_totalprice").alias("value"), F.row_number().over(w).cast("long").alias("version"))


@query(REVISIONS + " SELECT chain, rev_id, version, value FROM (SELECT *, row_number() OVER (PARTITION BY chain ORDER BY version DESC) AS r FROM rev) WHERE r = 1")
def revision_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.heads(_revisions(spark, sf_dir), "chain", "version").select("chain", "rev_id", "version", "value")


@query(REVISIONS + " SELECT chain, rev_id, version, value FROM (SELECT *, row_number() OVER (PARTITION BY chain ORDER BY version DESC) AS r FROM rev WHERE recorded <= TIMESTAMP '1999-06-30') WHERE r = 1")
def revision_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.heads(_revisions(spark, sf_dir), "chain", "version", C("recorded") <= F.lit("1999-06-30").cast("timestamp")).select("chain", "rev_id", "version", "value")


@query(REVISIONS + " SELECT chain, rev_id, version, version = max(version) OVER (PARTITION BY chain) AS is_target FROM rev")
def revision_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("chain")
    return _revisions(spark, sf_dir).select("chain", "rev_id", "version", (C("version") == F.max("version").over(w)).alias("is_target"))


@query("SELECT c_custkey, c_name, round(CASE WHEN c_custkey % 5 = 0 THEN c_acctbal * 2 ELSE c_acctbal END, 2) AS c_acctbal FROM customer UNION ALL SELECT c_custkey + 10000000, c_name, round(c_acctbal, 2) FROM customer WHERE c_custkey % 100 = 1")
def upsert_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", C("c_acctbal"))
    changed = c.where("c_custkey % 5 = 0").withColumn("c_acctbal", C("c_acctbal") * 2).unionByName(c.where("c_custkey % 100 = 1").withColumn("c_custkey", C("c_custkey") + 10_000_000))
    return lifecycle.upsert(c, changed, ["c_custkey"]).withColumn("c_acctbal", F.round("c_acctbal", 2))


@query("SELECT s_suppkey, s_acctbal FROM supplier WHERE NOT coalesce(s_acctbal < 0 OR s_suppkey % 7 = 0, false)")
def delete_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.delete(table(spark, sf_dir, "supplier"), (C("s_acctbal") < 0) | (C("s_suppkey") % 7 == 0)).select("s_suppkey", "s_acctbal")


@query("SELECT p_partkey, CASE WHEN p_size > 25 THEN 0 ELSE p_size END AS p_size, CASE WHEN p_size > 25 THEN 'large' ELSE p_type END AS p_type FROM part")
def update_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return lifecycle.update(p.select("p_partkey", "p_size", "p_type", C("p_size").alias("s")), C("s") > 25, {"p_size": F.lit(0).cast(p.schema["p_size"].dataType), "p_type": F.lit("large")}).drop("s")


SEGMENTS = EPISODES + """,
t AS (SELECT *, count(value) OVER w AS past, avg(value) OVER w AS m, stddev_pop(value) OVER w AS sd, lag(created_ms) OVER (PARTITION BY agent_id ORDER BY created_ms, id) AS before FROM ep WINDOW w AS (PARTITION BY agent_id ORDER BY created_ms, id ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
b AS (SELECT *, CASE WHEN before IS NULL OR created_ms - before > 3600000 OR coalesce(value > CASE WHEN past >= 2 THEN greatest(m + 2.0*sd, 0.0) END, false) THEN 1 ELSE 0 END AS edge FROM t),
s AS (SELECT *, sum(edge) OVER (PARTITION BY agent_id ORDER BY created_ms, id ROWS UNBOUNDED PRECEDING) AS segment FROM b)"""


@query(SEGMENTS + " SELECT id, agent_id, CAST(segment AS BIGINT) AS segment FROM s")
def episode_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions by gaps and surprising values."""
    return lifecycle.segments(episodes(spark, sf_dir), "agent_id", ["created_ms", "id"], "created_ms", "value").select("id", "agent_id", "segment")


@query(SEGMENTS + """, p AS (SELECT DISTINCT agent_id, segment, namespace FROM s), g AS (SELECT namespace, agent_id, count(*) AS segments FROM p GROUP BY 1, 2)
SELECT namespace, agent_id, segments FROM g WHERE segments >= 3""")
def entity_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types that occur in three or more segments of an agent."""
    s = lifecycle.segments(episodes(spark, sf_dir), "agent_id", ["created_ms", "id"], "created_ms", "value")
    return s.select("agent_id", "segment", "namespace").distinct().groupBy("namespace", "agent_id").agg(F.count("*").alias("segments")).where("segments >= 3")


@query(EPISODES + """, g AS (SELECT agent_id, namespace, created_ms - lag(created_ms) OVER (PARTITION BY agent_id, namespace ORDER BY created_ms, id) AS gap FROM ep),
r AS (SELECT agent_id || ':' || namespace AS k, gap, row_number() OVER (PARTITION BY agent_id, namespace ORDER BY gap) - 1 AS r FROM g WHERE gap IS NOT NULL),
st AS (SELECT k, count(*) AS g, avg(gap) AS m, stddev_pop(gap) AS sd FROM r GROUP BY k)
SELECT k, g + 1 AS n, gap AS period_ms FROM r JOIN st USING (k) WHERE r = g // 2 AND g >= 2 AND sd < 0.5*m""")
def recurrence_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = episodes(spark, sf_dir).withColumn("k", F.concat_ws(":", "agent_id", "namespace"))
    return lifecycle.periods(rows, "k", ["created_ms", "id"], "created_ms")


@query(EPISODES + " SELECT id, lag(id) OVER w AS prev_id, lead(id) OVER w AS next_id, row_number() OVER w AS position FROM ep WINDOW w AS (PARTITION BY namespace ORDER BY created_ms, id)")
def topic_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("namespace").orderBy("created_ms", "id")
    return episodes(spark, sf_dir).select("id", F.lag("id").over(w).alias("prev_id"), F.lead("id").over(w).alias("next_id"), F.row_number().over(w).cast("long").alias("position"))


@query(EPISODES + """, c AS (SELECT id, agent_id, CASE WHEN importance >= 0.9 THEN importance END AS own, max(CASE WHEN importance >= 0.9 THEN importance*0.7 END) OVER (PARTITION BY agent_id ORDER BY created_ms, id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near FROM ep)
SELECT id, round(CASE WHEN own IS NULL THEN near WHEN near IS NULL THEN own ELSE greatest(own, near) END, 6) AS score FROM c WHERE own IS NOT NULL OR near IS NOT NULL""")
def temporal_contiguity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.contiguous(episodes(spark, sf_dir), "agent_id", ["created_ms", "id"], C("importance") >= 0.9, C("importance")).select("id", F.round("score", 6).alias("score"))


@query(WALK + """, s AS (SELECT id, agent_id, created_ms // 1000 AS sec, row_number() OVER (PARTITION BY agent_id ORDER BY created_ms // 1000, id) AS r FROM ep),
w AS (SELECT agent_id, r, id, [sec] AS held, true AS accepted FROM s WHERE r = 1
 UNION ALL SELECT s.agent_id, s.r, s.id, list_concat(list_filter(w.held, lambda x: s.sec - x < 360000), CASE WHEN len(list_filter(w.held, lambda x: s.sec - x < 360000)) < 3 THEN [s.sec] ELSE [] END),
 len(list_filter(w.held, lambda x: s.sec - x < 360000)) < 3 FROM w JOIN s ON s.agent_id = w.agent_id AND s.r = w.r + 1)
SELECT id, accepted FROM w""")
def rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most three accepted writes of an agent in a hundred hours; rejected ones don't count."""
    rows = episodes(spark, sf_dir).select("id", "agent_id", F.floor(C("created_ms") / 1000).alias("sec"))
    return lifecycle.rate_limited(rows, "agent_id", "sec", 3, 360_000).select("id", "accepted")


@query(EPISODES + """, p AS (SELECT a.namespace AS cause, b.namespace AS effect, count(*) AS n FROM ep a JOIN ep b ON a.agent_id = b.agent_id AND b.created_ms > a.created_ms AND b.created_ms - a.created_ms <= 3600000 AND a.namespace <> b.namespace GROUP BY 1, 2)
SELECT cause, effect, n, round(least(n/10.0, 1.0), 6) AS strength, round(least(0.3+0.7*(1-1.0/(1+n)), 1.0), 6) AS confidence FROM p WHERE n >= 3 AND least(0.3+0.7*(1-1.0/(1+n)), 1.0) >= 0.4""")
def causal_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What follows what within an hour, by agent."""
    found = lifecycle.causal_pairs(episodes(spark, sf_dir), "created_ms", "namespace", "agent_id")
    return found.select("cause", "effect", "n", F.round("strength", 6).alias("strength"), F.round("confidence", 6).alias("confidence"))


@query("""
WITH p AS (SELECT o_orderkey AS id_a, lead(o_orderkey) OVER w AS id_b, o_totalprice/600000 AS score_a, lead(o_totalprice) OVER w/600000 AS score_b FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey))
SELECT id_a, id_b, CASE WHEN score_a >= score_b THEN id_a ELSE id_b END AS winner, round((CASE WHEN score_a >= score_b THEN score_b ELSE score_a END)*least(greatest(0.8-0.5*abs(score_a-score_b), 0.3), 0.8), 6) AS loser_score FROM p WHERE id_b IS NOT NULL""")
def reconsolidation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring orders of a customer as contradicting arguments."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    o = table(spark, sf_dir, "orders")
    pairs = o.select(C("o_orderkey").alias("id_a"), F.lead("o_orderkey").over(w).alias("id_b"), (C("o_totalprice") / 600000).alias("score_a"), (F.lead("o_totalprice").over(w) / 600000).alias("score_b")).where("id_b IS NOT NULL")
    return lifecycle.reconsolidate(pairs).select("id_a", "id_b", "winner", F.round("loser_score", 6).alias("loser_score"))


@query("""
WITH d AS (SELECT doc_id, lang, source, n_chars, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS r FROM documents)
SELECT doc_id, CASE WHEN r > 1 THEN 'duplicate' ELSE 'none' END AS flags, CAST(CASE WHEN r > 1 THEN 0.95 ELSE 0.0 END AS DOUBLE) AS score FROM d""")
def interference_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose content came before. Content is hashed before the shuffle, so texts stay where they are."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    first = d.groupBy("h").agg(F.min("doc_id").alias("first"))
    dup = C("doc_id") != C("first")
    return d.join(first, "h").select("doc_id", F.when(dup, "duplicate").otherwise("none").alias("flags"), F.when(dup, 0.95).otherwise(0.0).alias("score"))


@query(WALK + """, s AS (SELECT id, agent_id, CAST(ceil(octet_length(encode(props))/4.0) AS BIGINT) AS tokens, row_number() OVER (PARTITION BY agent_id ORDER BY created_ms, id) AS r FROM ep),
w AS (SELECT agent_id, r, id, CASE WHEN tokens <= 60 THEN tokens ELSE 0 END AS stored, tokens <= 60 AS ok FROM s WHERE r = 1
 UNION ALL SELECT s.agent_id, s.r, s.id, w.stored + CASE WHEN w.stored + s.tokens <= 60 THEN s.tokens ELSE 0 END, w.stored + s.tokens <= 60 FROM w JOIN s ON s.agent_id = w.agent_id AND s.r = w.r + 1)
SELECT id, CASE WHEN ok THEN 'accept' ELSE 'reject' END AS decision FROM w""")
def admission_token_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes of an agent within a budget of 60 tokens; what is rejected is not stored and doesn't count."""
    rows = episodes(spark, sf_dir).select("id", "agent_id", "created_ms", F.ceil(F.octet_length("props") / F.lit(4.0)).cast("long").alias("tokens"))
    return lifecycle.token_budgeted(rows, "agent_id", ["created_ms", "id"], "tokens", 60).select("id", F.when(C("accepted"), "accept").otherwise("reject").alias("decision"))


@query(EPISODES + """, r AS (SELECT id, importance, exp(-(1706745600000 - created_ms)/3600000.0/((24 + access_count)*(1 + 0.5*ln(greatest(access_count, 1))))) AS ret FROM ep)
SELECT id, round(ret*importance, 6) AS strength, CASE WHEN round(ret*importance, 6) < 0.01 THEN 'purge' WHEN round(ret*importance, 6) < 0.1 THEN 'archive' ELSE 'keep' END AS action FROM r""")
def forgetting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is forgotten, by strength to six decimals."""
    e = episodes(spark, sf_dir)
    ret = scoring.retention((1706745600000 - C("created_ms")) / 3600000.0, (24 + C("access_count")).cast("double"), C("access_count"))
    return e.select("id", F.round(ret * C("importance"), 6).alias("strength")).withColumn("action", F.when(C("strength") < 0.01, "purge").when(C("strength") < 0.1, "archive").otherwise("keep"))


@query(EPISODES + """, w AS (SELECT id, sum(10 + access_count) OVER (PARTITION BY agent_id ORDER BY importance DESC, id DESC ROWS UNBOUNDED PRECEDING) AS upto FROM ep)
SELECT id, CAST(upto AS BIGINT) AS upto, upto <= 200 AS kept FROM w""")
def working_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What fits 200 tokens of an agent's working memory."""
    rows = episodes(spark, sf_dir).withColumn("tokens", 10 + C("access_count"))
    return lifecycle.evict(rows, "agent_id", "importance", "id", "tokens", 200).select("id", "upto", "kept")


@query("""SELECT c_mktsegment AS concept, count(DISTINCT c_nationkey) AS agents, count(*) AS n, CASE WHEN min(c_acctbal) >= -500 THEN 'merge' ELSE 'contradict' END AS outcome FROM customer GROUP BY c_mktsegment HAVING count(DISTINCT c_nationkey) >= 2""")
def cross_agent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concepts that several agents hold: merged where all are confident."""
    g = table(spark, sf_dir, "customer").groupBy(C("c_mktsegment").alias("concept")).agg(F.count_distinct("c_nationkey").alias("agents"), F.count("*").alias("n"), F.min("c_acctbal").alias("lo"))
    return g.where("agents >= 2").select("concept", "agents", "n", F.when(C("lo") >= -500, "merge").otherwise("contradict").alias("outcome"))


@query("SELECT conv_id, turn, CASE WHEN role = 'system' THEN NULL ELSE text END AS text FROM conversations WHERE role IN ('user', 'system')")
def row_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the namespaces an agent may read, raw text only where it may."""
    from recollect.sources.policy import Policy, governed

    return governed(table(spark, sf_dir, "conversations"), Policy("role", ("user", "system"), raw=("user",)), "text").select("conv_id", "turn", "text")


@query("SELECT o_orderkey, l_linenumber FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F' AND l_returnflag = 'R'")
def hydrate_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result ids joined back to their records."""
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select("o_orderkey")
    return o.join(table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(C("l_orderkey").alias("o_orderkey"), "l_linenumber"), "o_orderkey")


@query("SELECT c_nationkey, c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM customer GROUP BY CUBE (c_nationkey, c_mktsegment)")
def cube_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").cube("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("total"))


QUESTION_SQL = ", ".join(f"replace('{q}', '{{content}}', t)" for q in text.QUESTIONS)


@query(f"""WITH c AS (SELECT doc_id, CASE WHEN length(text) <= 80 THEN text ELSE regexp_replace(substring(text, 1, 80), '\\s+\\S*\\z', '') END AS t FROM documents WHERE len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) >= 3)
SELECT doc_id, unnest([{QUESTION_SQL}]) AS question FROM c""")
def prospective_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions that documents may answer."""
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(text.questions(C("text"))).alias("question"))
