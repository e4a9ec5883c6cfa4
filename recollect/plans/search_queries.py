"""Retrieval queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recollect.functions import scoring, text
from recollect.operators import admission, context, search
from recollect.sources.settled import settled
from recollect.sources.views import table, vectors

from .register import registry

QUERIES, ORACLE, query = registry()


def _vector(spark: SparkSession, sf_dir: str, id: int) -> list[float]:
    return vectors(spark, sf_dir).where(F.col("id") == id).select("embedding").first()[0]


def _scored(spark: SparkSession, sf_dir: str) -> Column:
    return scoring.composite_score(F.col("score"), F.lit(0.5), (F.col("id") % 240).cast("double"), F.lit(0.0), F.lit(0.0), (F.col("id") % 10) / F.lit(10.0))


SIM = "greatest(0.0, least(1.0, list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))))"


@query(f"""
WITH q AS (SELECT embedding FROM embeddings WHERE vec_id = 1),
s AS (SELECT e.vec_id AS id, e.label, {SIM} AS sim FROM embeddings e, q WHERE e.label % 2 = 0 ORDER BY sim DESC, id LIMIT 10)
SELECT id, 'ns' || label AS namespace, round(sim, 6) AS similarity,
       round(0.35*sim + 0.2*0.5 + 0.2*exp(-ln(2)/168*(id % 240)) + 0.1*((id % 10)/10.0), 6) AS score FROM s""")
def recall_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of even namespaces, with composite scores."""
    even = F.substring("namespace", 3, 9).cast("int") % 2 == 0
    top = search.vector_search(vectors(spark, sf_dir), _vector(spark, sf_dir, 1), 10, where=even)
    return top.select("id", "namespace", F.round("score", 6).alias("similarity"), F.round(_scored(spark, sf_dir), 6).alias("score"))


@query("""
WITH q AS (SELECT embedding FROM embeddings WHERE vec_id = 2)
SELECT e.vec_id AS id, round(1/(1+pow(list_distance(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 2)), 6) AS score
FROM embeddings e, q ORDER BY score DESC, id LIMIT 10""")
def vector_search_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = search.vector_search(vectors(spark, sf_dir), _vector(spark, sf_dir, 2), 10, "l2")
    return top.select("id", F.round("score", 6).alias("score"))


@query("""
WITH q AS (SELECT embedding FROM embeddings WHERE vec_id = 3)
SELECT e.vec_id AS id, round(greatest(0.0, least(1.0, list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])))), 6) AS score
FROM embeddings e, q ORDER BY greatest(0.0, least(1.0, list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])))) DESC, id LIMIT 10""")
def vector_search_dot(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = search.vector_search(vectors(spark, sf_dir), _vector(spark, sf_dir, 3), 10, "dot")
    return top.select("id", F.round("score", 6).alias("score"))


@query(f"""
WITH s AS (SELECT q.vec_id AS query_id, e.vec_id AS id, {SIM} AS sim FROM embeddings q JOIN embeddings e ON q.vec_id % 20 = 0 AND e.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id) AS rank FROM s)
SELECT query_id, id, rank, round(sim, 6) AS score FROM r WHERE rank <= 5""")
def vector_search_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest of every twentieth vector among all others."""
    v = vectors(spark, sf_dir)
    queries = v.where(F.col("id") % 20 == 0).select(F.col("id").alias("query_id"), F.col("embedding").alias("query"))
    return search.vector_search_many(v, queries, 5).select("query_id", "id", "rank", F.round("score", 6).alias("score"))


BM25 = """
WITH tok AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> '') AS w FROM documents),
t AS (SELECT id, len(w) AS len, len(list_filter(w, lambda x: x = 'then')) AS tf0, len(list_filter(w, lambda x: x = 'from')) AS tf1 FROM tok),
st AS (SELECT count(*) AS n, avg(len) AS avg, sum(CASE WHEN tf0 > 0 THEN 1 ELSE 0 END) AS df0, sum(CASE WHEN tf1 > 0 THEN 1 ELSE 0 END) AS df1 FROM t),
bm AS (SELECT id, ln(1+(n-df0+0.5)/(df0+0.5))*tf0*2.2/(tf0+1.2*(0.25+0.75*len/avg)) + ln(1+(n-df1+0.5)/(df1+0.5))*tf1*2.2/(tf1+1.2*(0.25+0.75*len/avg)) AS score FROM t, st WHERE tf0 > 0 OR tf1 > 0)
"""


def _bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return search.bm25(docs, ["then", "from"])


@query(BM25 + "SELECT id, round(score, 6) AS score FROM bm ORDER BY bm.score DESC, id LIMIT 20")
def full_text_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bm25(spark, sf_dir).orderBy(F.desc("score"), "id").limit(20).select("id", F.round("score", 6).alias("score"))


@query("""SELECT doc_id AS id, (length(lower(text)) - length(replace(lower(text), 'with the', ''))) / 8.0 AS score FROM documents
WHERE contains(lower(text), 'with the')""")
def full_text_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where(F.contains(F.lower("text"), F.lit("with the")))
    return docs.select(F.col("doc_id").alias("id"), text.substring_score(F.col("text"), "with the").cast("double").alias("score"))


LISTS = BM25.rstrip() + f""",
q AS (SELECT embedding FROM embeddings WHERE vec_id = 1),
va AS (SELECT e.vec_id AS id, {SIM} AS score FROM embeddings e, q ORDER BY score DESC, id LIMIT 40),
fb AS (SELECT id, score FROM bm ORDER BY score DESC, id LIMIT 40)
"""


def _two_lists(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    a = search.vector_search(vectors(spark, sf_dir), _vector(spark, sf_dir, 1), 40).select("id", "score")
    return a, _bm25(spark, sf_dir).orderBy(F.desc("score"), "id").limit(40)


@query(LISTS + """,
ra AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) - 1 AS r FROM va), rb AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) - 1 AS r FROM fb)
SELECT coalesce(ra.id, rb.id) AS id, round(1.0/(coalesce(ra.r, (SELECT count(*) FROM ra)+(SELECT count(*) FROM rb))+60) + 1.0/(coalesce(rb.r, (SELECT count(*) FROM ra)+(SELECT count(*) FROM rb))+60), 9) AS score
FROM ra FULL JOIN rb ON ra.id = rb.id""")
def hybrid_rank_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vector and full-text lists fused by reciprocal ranks."""
    return search.reciprocal_rank_fusion(*_two_lists(spark, sf_dir)).select("id", F.round("score", 9).alias("score"))


@query(LISTS + """,
na AS (SELECT id, CASE WHEN max(score) OVER () = min(score) OVER () THEN 1.0 ELSE (score - min(score) OVER ())/(max(score) OVER () - min(score) OVER ()) END AS s FROM va),
nb AS (SELECT id, CASE WHEN max(score) OVER () = min(score) OVER () THEN 1.0 ELSE (score - min(score) OVER ())/(max(score) OVER () - min(score) OVER ()) END AS s FROM fb)
SELECT coalesce(na.id, nb.id) AS id, round(0.5*coalesce(na.s, 0) + 0.5*coalesce(nb.s, 0), 6) AS score FROM na FULL JOIN nb ON na.id = nb.id""")
def hybrid_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.linear_combination(*_two_lists(spark, sf_dir)).select("id", F.round("score", 6).alias("score"))


@query(LISTS + """,
u AS (SELECT id, score FROM va UNION ALL SELECT id, score FROM fb)
SELECT id, round(max(score), 6) AS score FROM u GROUP BY id""")
def merge_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two result lists as one, the best score of each id."""
    return search.merge(list(_two_lists(spark, sf_dir))).select("id", F.round("score", 6).alias("score"))


@query(f"""
WITH q AS (SELECT embedding FROM embeddings WHERE vec_id = 5),
s AS (SELECT e.vec_id AS id, {SIM} AS sim FROM embeddings e, q),
broad AS (SELECT id, sim AS score, 0 AS boosted FROM s ORDER BY sim DESC, id LIMIT 24),
win AS (SELECT id, sim*1.25 AS score, 1 AS boosted FROM (SELECT * FROM s WHERE id BETWEEN 100 AND 300 ORDER BY sim DESC, id LIMIT 12)),
u AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY boosted DESC) AS r FROM (SELECT * FROM broad UNION ALL SELECT * FROM win))
SELECT id, boosted, round(score, 6) AS score FROM u WHERE r = 1 ORDER BY u.score DESC, id LIMIT 12""")
def temporal_dual_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.dual_pass(vectors(spark, sf_dir), _vector(spark, sf_dir, 5), 12, F.col("id").between(100, 300))
    return found.select("id", "boosted", F.round("score", 6).alias("score"))


@query("""
WITH d AS (SELECT label, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
q AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id IN (1, 2, 3)),
s AS (SELECT d.label, q.vec_id, max(list_cosine_similarity(q.e, d.e)) AS m FROM d, q GROUP BY 1, 2)
SELECT label, round(sum(m), 6) AS score FROM s GROUP BY label""")
def multivector_max_sim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Late interaction of three query vectors with all vectors of each label: the best cosine of each,
    taken before the shuffle, then summed; no label's vectors meet in one row."""
    e = table(spark, sf_dir, "embeddings").select("label", "embedding")
    best = e.groupBy("label").agg(*[F.max(scoring.cosine(F.array(*[F.lit(float(x)) for x in _vector(spark, sf_dir, i)]), F.col("embedding"))).alias(f"m{i}") for i in (1, 2, 3)])
    return best.select("label", F.round(F.col("m1") + F.col("m2") + F.col("m3"), 6).alias("score"))


@query(f"""
WITH q AS (SELECT embedding FROM embeddings WHERE vec_id = 7),
s AS (SELECT e.vec_id AS id, {SIM} AS score FROM embeddings e, q ORDER BY score DESC, id LIMIT 60),
p AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS r FROM s)
SELECT a.id, round(CASE WHEN a.score >= 0.2 AND EXISTS (SELECT 1 FROM p b WHERE b.r < a.r AND b.r >= a.r - 20 AND b.score >= 0.2 AND abs(b.score - a.score) < 0.002) THEN a.score*0.5 ELSE a.score END, 6) AS score FROM p a""")
def competitive_inhibition(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = search.vector_search(vectors(spark, sf_dir), _vector(spark, sf_dir, 7), 60).select("id", "score")
    return search.inhibit(top, 0.2, 0.002).select("id", F.round("score", 6).alias("score"))


@query("""
WITH c AS (SELECT label, min(vec_id) AS id FROM embeddings GROUP BY label),
q AS (SELECT CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id = 1),
s AS (SELECT c.id, c.label, list_cosine_similarity(CAST(x.embedding AS DOUBLE[]), q.e) AS score FROM c JOIN embeddings x ON x.vec_id = c.id, q WHERE list_cosine_similarity(CAST(x.embedding AS DOUBLE[]), q.e) >= -0.5 ORDER BY score DESC, c.id LIMIT 5),
m AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS r FROM embeddings)
SELECT id, round(score, 6) AS score, 'summary' AS kind FROM s
UNION ALL SELECT m.vec_id, round(max(s.score)*0.8, 6), 'member' FROM m JOIN s ON m.label = s.label WHERE m.r <= 10 GROUP BY m.vec_id""")
def community_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each label's first vector stands for its community."""
    e = table(spark, sf_dir, "embeddings").select("label", F.col("vec_id").alias("id"), "embedding")
    summaries = e.groupBy("label").agg(F.min(F.struct("id", "embedding")).alias("first"), F.slice(F.array_sort(F.collect_list("id")), 1, 10).alias("members")).select("first.*", "members")
    return search.community_search(e, summaries, _vector(spark, sf_dir, 1), least=-0.5).select("id", F.round("score", 6).alias("score"), "kind")


@query("""
WITH q AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id % 20 = 0),
s AS (SELECT q.vec_id AS id, max(list_cosine_similarity(q.e, CAST(x.embedding AS DOUBLE[]))) AS m FROM q JOIN embeddings x ON x.vec_id <> q.vec_id GROUP BY q.vec_id),
st AS (SELECT avg(1-m) AS mean, stddev_samp(1-m) AS dev FROM s)
SELECT id, round(m, 6) AS max_similarity, round(greatest(0.0, least(2.0, (1-greatest(0.0, least(1.0, m)))*(1+(1-m-mean)/dev))), 6) AS rpe FROM s, st""")
def prediction_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far every twentieth vector is from all others, against their mean."""
    v = vectors(spark, sf_dir)
    new = v.where(F.col("id") % 20 == 0).select("id", "embedding")
    best = settled(admission.nearest(new, v).where("distance IS NOT NULL").select("id", (1 - F.col("distance")).alias("m")))
    stats = best.agg(F.avg(1 - F.col("m")).alias("mean"), F.stddev_samp(1 - F.col("m")).alias("dev"))
    above = 1 - F.col("m") - F.col("mean")
    without = F.when(above == 0, float("nan")).otherwise(F.signum(above) * float("inf"))  # as SQL divides by no deviation
    z = F.when(F.col("dev") == 0, without).otherwise(above / F.nullif(F.col("dev"), F.lit(0.0)))
    return best.join(F.broadcast(stats)).select("id", F.round("m", 6).alias("max_similarity"), F.round(scoring.prediction_error(scoring.clamp(F.col("m")), z), 6).alias("rpe"))


@query("""
WITH u AS (SELECT label, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])))) AS v FROM embeddings),
p AS (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM u),
s AS (SELECT label, pos, sum(x) AS s FROM p GROUP BY 1, 2), q AS (SELECT label, sum(s*s) AS sq FROM s GROUP BY 1), n AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1)
SELECT q.label, n, round((sq - n)/(n*(n-1)), 6) AS coherence FROM q JOIN n USING (label) WHERE n > 1""")
def coherence_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean pairwise cosine of each label's vectors, from sums of unit vectors."""
    e = table(spark, sf_dir, "embeddings").select("label", F.transform("embedding", lambda x: x.cast("double") / scoring.norm(F.col("embedding"))).alias("u"))
    sums = e.select("label", F.posexplode("u")).groupBy("label", "pos").agg(F.sum("col").alias("s")).groupBy("label").agg(F.sum(F.col("s") * F.col("s")).alias("sq"))
    counts = table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count("*").alias("n")).where("n > 1")
    return sums.join(counts, "label").select("label", "n", F.round((F.col("sq") - F.col("n")) / (F.col("n") * (F.col("n") - 1)), 6).alias("coherence"))


@query("""
WITH e AS (SELECT label, embedding FROM embeddings), p AS (SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS pos FROM e),
m AS (SELECT label, pos, avg(x) AS x FROM p GROUP BY 1, 2), n AS (SELECT label, sqrt(sum(x*x)) AS n FROM m GROUP BY 1)
SELECT m.label, pos, round(x/n, 6) AS x FROM m JOIN n USING (label)""")
def mean_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each label's mean vector at unit length, a row per element."""
    e = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding")).groupBy("label", "pos").agg(F.avg(F.col("col").cast("double")).alias("x"))
    size = e.groupBy("label").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("n"))
    return e.join(size, "label").select("label", (F.col("pos") + 1).cast("long").alias("pos"), F.round(F.col("x") / F.col("n"), 6).alias("x"))


@query()
def context_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source what fits 400 tokens, chosen greedily by score per token; tested against a plain walk."""
    docs = table(spark, sf_dir, "documents")
    rows = docs.select(F.col("doc_id").alias("id"), "source", F.round((F.col("doc_id") % 97) / 97.0, 6).alias("score"), scoring.token_count(F.col("text")).alias("token_count"))
    return context.fit_budget(rows, 400, "source")


@query("""
WITH q AS (SELECT embedding FROM embeddings WHERE vec_id = 1),
s AS (SELECT e.vec_id, e.embedding, {SIM} AS sim FROM embeddings e, q ORDER BY sim DESC, e.vec_id LIMIT 8),
u AS (SELECT list_transform(CAST(embedding AS DOUBLE[]), lambda x: x / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])))) AS v FROM s),
p AS (SELECT unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM u), t AS (SELECT pos, sum(x) AS s FROM p GROUP BY 1), c AS (SELECT sum(s*s) AS sq FROM t),
g AS (SELECT 0.3*least(count(*)/5.0, 1.0) + 0.3*avg(sim) + 0.2*greatest(0.0, least(1.0, (max(sq) - count(*))/(count(*)*(count(*)-1)))) + 0.2*least(sum(64)/1000.0, 1.0) AS q FROM s, c)
SELECT vec_id AS id, round(g.q, 6) AS quality_score, CASE WHEN g.q >= 0.5 THEN 'pass' ELSE 'escalate' END AS quality_action FROM s, g""".replace("{SIM}", SIM))
def quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = search.vector_search(vectors(spark, sf_dir), _vector(spark, sf_dir, 1), 8).withColumn("token_count", F.lit(64))
    return context.quality_gate(top, 1000).select("id", F.round("quality_score", 6).alias("quality_score"), "quality_action")


@query()
def topic_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy topics of each conversation's turns; tested against a plain loop."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id"), F.col("turn").alias("id"), "text")
    return context.topics(turns, "conv_id", 0.2)


@query("""
WITH r AS (SELECT d.source, d.doc_id, l.quality, row_number() OVER (PARTITION BY d.source ORDER BY d.n_chars DESC, d.doc_id) AS k FROM documents d JOIN labels l USING (doc_id)),
h AS (SELECT source, sum(CASE WHEN k <= 10 AND quality = 1 THEN 1 ELSE 0 END) AS hits, sum(quality) AS good, min(CASE WHEN quality = 1 THEN k END) AS first,
 sum(CASE WHEN k <= 10 THEN quality/log2(k+1) ELSE 0 END) AS dcg FROM r GROUP BY source),
i AS (SELECT source, sum(1/log2(j+1)) AS ideal FROM h, generate_series(1, 10) g(j) WHERE j <= good GROUP BY source)
SELECT source, round(hits/10.0, 6) AS p_at_10, round(hits/CAST(good AS DOUBLE), 6) AS r_at_10, round(1.0/first, 6) AS mrr, round(dcg/ideal, 6) AS ndcg FROM h JOIN i USING (source) WHERE good > 0""")
def retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision, recall, reciprocal rank and nDCG at ten of each source's longest documents, judged by quality."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    r = d.withColumn("k", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")))
    top = F.col("k") <= 10
    h = r.groupBy("source").agg(
        F.sum(F.when(top, F.col("quality")).otherwise(0)).alias("hits"), F.sum("quality").alias("good"), F.min(F.when(F.col("quality") == 1, F.col("k"))).alias("first"),
        F.sum(F.when(top, F.col("quality") / F.log2(F.col("k") + 1)).otherwise(0.0)).alias("dcg"),
    ).where("good > 0")
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("good"), F.lit(10)).cast("int")), F.lit(0.0), lambda s, j: s + 1 / F.log2(j + 1))
    return h.select("source", F.round(F.col("hits") / 10.0, 6).alias("p_at_10"), F.round(F.col("hits") / F.col("good"), 6).alias("r_at_10"), F.round(1.0 / F.col("first"), 6).alias("mrr"), F.round(F.col("dcg") / ideal, 6).alias("ndcg"))


@query()
def trigram_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deterministic trigram vectors of the conversations' turns, with their cosine to the first turn;
    tested against a plain version."""
    turns = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    e = context.embed_trigrams(turns)
    first = e.orderBy("id").limit(1).select(F.col("embedding").alias("q"))
    return e.join(F.broadcast(first)).select("id", F.round(scoring.cosine(F.col("embedding"), F.col("q")), 6).alias("similarity"))
