"""Scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.functions import scoring, text
from recollect.sources.views import table

from .register import registry

QUERIES, ORACLE, query = registry()

# Arguments of the score functions, from line items: all in the ranges that memories have.
ARGS = "l_orderkey, l_linenumber, l_discount*10 AS sim, l_tax*12 AS imp, l_quantity*7.5 AS age, l_discount*5 AS act, l_tax*3 AS causal, l_quantity/50 AS surprise, CAST(l_linenumber AS BIGINT) AS freq, l_partkey, l_suppkey"


def _args(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_discount*10 AS sim", "l_tax*12 AS imp", "l_quantity*7.5 AS age", "l_discount*5 AS act", "l_tax*3 AS causal", "l_quantity/50 AS surprise", "CAST(l_linenumber AS BIGINT) AS freq"
    )


def _sql(expr: str, name: str) -> str:
    return f"WITH a AS (SELECT {ARGS} FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round({expr}, 6) AS DOUBLE) AS {name} FROM a"


def _one(spark: SparkSession, sf_dir: str, column, name: str) -> DataFrame:
    return _args(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(column, 6).alias(name))


C = F.col


@query(_sql("0.35*sim + 0.2*imp + 0.2*exp(-ln(2)/168*age) + 0.1*act + 0.05*causal + 0.1*surprise", "score"))
def composite_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _one(spark, sf_dir, scoring.composite_score(C("sim"), C("imp"), C("age"), C("act"), C("causal"), C("surprise")), "score")


@query(_sql("exp(-0.05/(1+imp)/(1+freq)*age)", "decay"))
def temporal_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _one(spark, sf_dir, scoring.temporal_decay(C("age"), F.lit(0.05), C("freq"), C("imp")), "decay")


@query(_sql("0.05/(1+imp)/(1+freq)", "rate"))
def decay_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _one(spark, sf_dir, scoring.decay_rate(F.lit(0.05), C("imp"), C("freq")), "rate")


@query(_sql("greatest(0.0, least(2.0, (1-sim)*(1+(surprise-0.5)*4)))", "rpe"))
def rpe_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _one(spark, sf_dir, scoring.prediction_error(C("sim"), (C("surprise") - 0.5) * 4), "rpe")


@query(_sql("1/(1+exp(-(surprise*6-3)))", "surprise_score"))
def surprise_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _one(spark, sf_dir, scoring.surprise_score(C("surprise") * 6 - 3), "surprise_score")


@query(_sql("sim*imp*ln(1+freq)", "relevance"))
def causal_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _one(spark, sf_dir, scoring.causal_relevance(C("sim"), C("imp"), C("freq")), "relevance")


@query(_sql("least(1.0, 0.3*least(sim,1.0) + 0.2*least(imp,1.0) + 0.2*exp(-0.01/(1+least(imp,1.0))/(1+freq)*age) + 0.1*least(act,1.0) + 0.05*least(causal,1.0) + 0.1*least(surprise,1.0) + 0.05*0.8)", "score"))
def recall_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = {"similarity": C("sim"), "importance": C("imp"), "recency": scoring.recency(C("age"), C("imp"), C("freq")), "activation": C("act"), "causal": C("causal"), "surprise": C("surprise"), "source": scoring.source_reliability(F.lit("agent_generated"))}
    return _one(spark, sf_dir, scoring.recall_score(terms), "score")


@query(_sql("exp(-age/((24+freq)*(1+0.5*ln(CAST(freq AS DOUBLE)))))", "retention"))
def retention_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _one(spark, sf_dir, scoring.retention(C("age"), 24 + C("freq"), C("freq")), "retention")


@query(_sql("imp*pow(0.95, age/168)", "importance"))
def importance_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _one(spark, sf_dir, scoring.decayed_importance(C("imp"), C("age")), "importance")


@query(_sql("greatest(0.0, least(1.0, 2*(sim-0.5)))", "interference"))
def interference_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _one(spark, sf_dir, scoring.interference(C("sim")), "interference")


@query(_sql("CASE WHEN freq*3 < 10 THEN 0.0 ELSE 0.7*(1-sim) + 0.3*(CASE WHEN age > 300 THEN 0.5 ELSE 0.0 END) END", "anomaly"))
def anomaly_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _one(spark, sf_dir, scoring.anomaly(C("sim"), C("age") > 300, C("freq") * 3), "anomaly")


@query(_sql("greatest(0.1, least(1.0, (CASE WHEN freq <= 1 THEN 0.3 WHEN freq <= 3 THEN 0.5 WHEN freq <= 7 THEN 0.7 ELSE 0.85 END) - 0.15*(l_suppkey % 3)))", "confidence"))
def evidence_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _one(spark, sf_dir, scoring.evidence_confidence(C("freq"), C("l_suppkey") % 3), "confidence")


@query("SELECT o_orderkey, CAST(CASE o_orderpriority WHEN '1-URGENT' THEN 1.0 WHEN '2-HIGH' THEN 0.8 WHEN '3-MEDIUM' THEN 0.6 WHEN '4-NOT SPECIFIED' THEN 0.5 ELSE 0.4 END AS DOUBLE) AS trust FROM orders")
def source_reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order priorities stand for kinds of source."""
    o = table(spark, sf_dir, "orders")
    kind = F.when(C("o_orderpriority") == "1-URGENT", "direct_observation").when(C("o_orderpriority") == "2-HIGH", "agent_generated").when(C("o_orderpriority") == "3-MEDIUM", "inferred").when(C("o_orderpriority") == "4-NOT SPECIFIED", "cross_agent").otherwise("other")
    return o.select("o_orderkey", scoring.source_reliability(kind).alias("trust"))


@query("SELECT doc_id, CAST(ceil(octet_length(encode(text))/4.0) AS INTEGER) AS tokens FROM documents")
def token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", scoring.token_count(C("text")).alias("tokens"))


THREAT_SQL = " OR ".join(f"contains(lower(text), '{p}')" for p in text.THREATS)


@query(f"SELECT doc_id, ({THREAT_SQL} OR octet_length(encode(text)) < 5 OR octet_length(encode(text)) > 50000) AS threat FROM documents")
def detect_threat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.is_threat(C("text")).alias("threat"))


@query("""
WITH p AS (SELECT conv_id, turn, string_split_regex(trim(regexp_replace(lower(text), '\\s+', ' ', 'g')), ' ') AS w, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM conversations),
j AS (SELECT conv_id, turn, list_distinct(list_filter(w, lambda x: x <> '')) AS a, list_distinct(list_filter(string_split_regex(trim(regexp_replace(lower(nxt), '\\s+', ' ', 'g')), ' '), lambda x: x <> '')) AS b FROM p WHERE nxt IS NOT NULL)
SELECT conv_id, turn, round(CASE WHEN len(a) + len(b) - len(list_intersect(a, b)) = 0 THEN 0.0 ELSE len(list_intersect(a, b))/CAST(len(a) + len(b) - len(list_intersect(a, b)) AS DOUBLE) END, 6) AS jaccard FROM j""")
def word_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shared words of neighbouring turns."""
    from pyspark.sql import Window

    t = table(spark, sf_dir, "conversations")
    n = t.withColumn("nxt", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))).where("nxt IS NOT NULL")
    return n.select("conv_id", "turn", F.round(text.jaccard(text.split_words(F.lower("text")), text.split_words(F.lower("nxt"))), 6).alias("jaccard"))


NEG_SQL = lambda c: "(" + " OR ".join("contains({}, '{}')".format(c, n.replace("'", "''")) for n in text.NEGATIONS) + ")"
OPP_SQL = "(" + " OR ".join(f"(contains(a, '{x}') AND contains(b, '{y}')) OR (contains(a, '{y}') AND contains(b, '{x}'))" for x, y in text.OPPOSITES) + ")"


@query(f"""
WITH p AS (SELECT conv_id, turn, lower(text) AS a, lower(lead(text) OVER (PARTITION BY conv_id ORDER BY turn)) AS b FROM conversations),
w AS (SELECT *, list_distinct(list_filter(regexp_split_to_array(a, '\\s+'), lambda x: x <> '')) AS wa, list_distinct(list_filter(regexp_split_to_array(b, '\\s+'), lambda x: x <> '')) AS wb FROM p WHERE b IS NOT NULL),
o AS (SELECT *, CASE WHEN len(wa) = 0 OR len(wb) = 0 THEN 0.0 ELSE len(list_intersect(wa, wb))/CAST(len(wa)+len(wb)-len(list_intersect(wa, wb)) AS DOUBLE) END AS o, {NEG_SQL('a')} <> {NEG_SQL('b')} AS differ, {OPP_SQL} AS opp FROM w)
SELECT conv_id, turn, CASE WHEN o > 0.3 AND differ THEN 'contradiction' WHEN opp AND o > 0.2 THEN 'contradiction' WHEN o > 0.6 AND NOT differ THEN 'entailment' ELSE 'neutral' END AS label,
round(CASE WHEN o > 0.3 AND differ THEN 0.75+0.2*o WHEN opp AND o > 0.2 THEN 0.7+0.2*o WHEN o > 0.6 AND NOT differ THEN 0.6+0.3*o ELSE 0.3+0.3*(1-o) END, 6) AS score FROM o""")
def entailment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn against the next: contradiction, entailment or neutral."""
    from pyspark.sql import Window

    t = table(spark, sf_dir, "conversations")
    n = t.withColumn("nxt", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))).where("nxt IS NOT NULL")
    e = n.select("conv_id", "turn", text.entailment(C("text"), C("nxt")).alias("e"))
    return e.select("conv_id", "turn", C("e.label").alias("label"), F.round("e.score", 6).alias("score"))


@query("SELECT doc_id, lower(substring(text, 1, 50)) AS key FROM documents")
def content_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.content_key(C("text")).alias("key"))


@query("""
WITH w AS (SELECT conv_id, turn, unnest(list_distinct(list_transform(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''), lambda x: lower(regexp_replace(x, '^[^\\p{L}\\p{N}]+|[^\\p{L}\\p{N}]+$', '', 'g'))))) AS term FROM conversations)
SELECT conv_id, turn, count(*) AS terms FROM w WHERE octet_length(encode(term)) > 2 AND term NOT IN (""" + ", ".join(f"'{w}'" for w in text.STOP_WORDS) + ") GROUP BY conv_id, turn")
def lexical_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(text.lexical_terms(C("text"))).cast("long").alias("terms"))
    return t.where("terms > 0")


@query("""WITH m AS (SELECT event_id, (CAST(round(least(greatest(value/100, 0.0), 1.0)*1000000) AS BIGINT) + 50000)//100000 AS t FROM events WHERE value IS NOT NULL)
SELECT event_id, CAST(t // 10 AS VARCHAR) || '.' || CAST(t % 10 AS VARCHAR) AS bucket FROM m""")
def importance_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importance to one decimal, as text; halves go up."""
    e = table(spark, sf_dir, "events").where(C("value").isNotNull())
    return e.select("event_id", text.importance_bucket(F.least(F.greatest(C("value") / 100, F.lit(0.0)), F.lit(1.0))).alias("bucket"))
