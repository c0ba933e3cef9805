"""Queries of ranking, fusion, routing and quality of retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmesh.functions import text as T
from quillmesh.operators import metrics as M
from quillmesh.operators import retrieval as R
from quillmesh.plans.base import Registry, table

REGISTRY = Registry()
query = REGISTRY.query

BM25_SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-zʻʼ0-9]+') AS t FROM documents),
s AS (SELECT count(*) AS n, avg(len(t)) AS a FROM d),
p AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM d) GROUP BY 1, 2, 3),
f AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
q AS (SELECT item_id AS query_id, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-zʻʼ0-9]+')) AS term FROM benchmark) GROUP BY 1, 2),
x AS (SELECT query_id, doc_id, sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / a))) AS score FROM q JOIN p USING (term) JOIN f USING (term) CROSS JOIN s GROUP BY 1, 2),
r AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM x)
"""
KNN_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
c AS (SELECT q.vec_id AS query_id, v.vec_id, list_cosine_similarity(q.e, v.e) AS score FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0),
k AS (SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS rank FROM c)
"""


def _tokens(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.search_tokens("text").alias("tokens"))


def _passages(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), T.search_tokens("text").alias("terms"))


def _neighbours(spark, sf_dir, k):
    vectors = table(spark, sf_dir, "embeddings")
    return R.knn(vectors, vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector")), k)


@query(BM25_SQL + "SELECT query_id, doc_id, round(score, 6) AS score, CAST(rank AS BIGINT) AS rank FROM r WHERE rank <= 10")
def bm25_topk(spark, sf_dir):
    return R.bm25(_tokens(spark, sf_dir), _passages(spark, sf_dir), k=10).select("query_id", "doc_id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@query(KNN_SQL + "SELECT query_id, vec_id, round(score, 5) AS score, rank FROM k WHERE rank <= 10")
def knn_topk(spark, sf_dir):
    return _neighbours(spark, sf_dir, 10).select("query_id", "vec_id", F.round("score", 5).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 5) AS norm, CAST(len(embedding) AS BIGINT) AS dims FROM embeddings")
def vector_norms(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(R.norm("embedding"), 5).alias("norm"), F.size("embedding").cast("bigint").alias("dims"))


@query("SELECT a.vec_id AS vec_id, b.vec_id AS next_id, round(list_cosine_similarity(list_transform(a.embedding, lambda x: CAST(x AS DOUBLE)), list_transform(b.embedding, lambda x: CAST(x AS DOUBLE))), 5) AS cosine, round(greatest(0, list_cosine_similarity(list_transform(a.embedding, lambda x: CAST(x AS DOUBLE)), list_transform(b.embedding, lambda x: CAST(x AS DOUBLE)))), 5) AS score FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def cosine_neighbouring(spark, sf_dir):
    a, b = table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), table(spark, sf_dir, "embeddings").select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec_id").alias("next_id"), F.col("embedding").alias("other"))
    near = R.cosine("embedding", "other")
    return a.join(b, "vec_id").select("vec_id", "next_id", F.round(near, 5).alias("cosine"), F.round(F.greatest(F.lit(0.0), near), 5).alias("score"))


@query(BM25_SQL.strip() + ", " + KNN_SQL.strip().removeprefix("WITH ").replace("v AS (", "v AS (", 1) + """,
fused AS (SELECT query_id, doc_id, sum(w / (3 + rank)) AS score FROM (SELECT query_id, doc_id, rank, 0.2 AS w FROM r WHERE rank <= 50 UNION ALL SELECT query_id, vec_id, rank, 0.8 FROM k WHERE rank <= 50) GROUP BY 1, 2)
SELECT query_id, doc_id, round(score, 6) AS score, rank FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM fused) WHERE rank <= 10""")
def rrf_fusion(spark, sf_dir):
    lexical = R.bm25(_tokens(spark, sf_dir), _passages(spark, sf_dir), k=50)
    vector = _neighbours(spark, sf_dir, 50).withColumnRenamed("vec_id", "doc_id")
    fused = R.fuse([(vector, 0.8), (lexical, 0.2)])
    return fused.where("rank <= 10").select("query_id", "doc_id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@query(KNN_SQL + """, l AS (SELECT k.query_id, min(CASE WHEN a.label = b.label THEN rank END) AS f FROM k JOIN embeddings a ON a.vec_id = k.query_id JOIN embeddings b ON b.vec_id = k.vec_id WHERE rank <= 10 GROUP BY 1)
SELECT count(*) AS n_queries, round(avg(CASE WHEN f <= 1 THEN 1.0 ELSE 0 END), 6) AS recall_1, round(avg(CASE WHEN f <= 3 THEN 1.0 ELSE 0 END), 6) AS recall_3, round(avg(CASE WHEN f <= 10 THEN 1.0 ELSE 0 END), 6) AS recall_10, round(avg(coalesce(1 / f, 0)), 6) AS mrr FROM l""")
def recall_mrr(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    found = _neighbours(spark, sf_dir, 10)
    named = found.join(vectors.select("vec_id", "label"), "vec_id").join(vectors.select(F.col("vec_id").alias("query_id"), F.col("label").alias("wanted")), "query_id")
    return M.recall_and_mrr(named.groupBy("query_id").agg(F.min(F.when(F.col("label") == F.col("wanted"), F.col("rank"))).alias("first_rank")))


@query("""
WITH x AS (SELECT doc_id, source, CAST(2 * len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS BIGINT) AS tokens, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rank FROM documents),
y AS (SELECT *, sum(tokens + 40) OVER (PARTITION BY source ORDER BY rank) AS used FROM x)
SELECT source, doc_id, CAST(used AS BIGINT) AS used, 'C' || rank AS tag FROM y WHERE used <= 6000""")
def context_budget(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("query_id"), "doc_id", F.size(F.filter(F.split("text", r"\s+", -1), lambda x: x != "")).cast("bigint").alias("w"))
    placed = R.ranked(docs.withColumn("tokens", F.col("w") * 2).withColumn("even", F.lit(0)), "query_id", "even", "doc_id", R.CONTEXT_BUDGET // R.TAG_COST)
    return R.pack_context(placed).select(F.col("query_id").alias("source"), "doc_id", F.col("used").cast("bigint").alias("used"), "tag")


@query("""
WITH s AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents), q AS (SELECT item_id AS query_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]+'))) AS x FROM benchmark),
h AS (SELECT doc_id, unnest(w) AS x FROM s), f AS (SELECT x, count(*) AS df FROM h GROUP BY 1), n AS (SELECT count(*) AS n FROM s),
w AS (SELECT query_id, q.x, ln((n + 1) / (coalesce(df, 0) + 1)) + 1 AS weight FROM q LEFT JOIN f ON q.x = f.x CROSS JOIN n), t AS (SELECT query_id, sum(weight) AS total FROM w GROUP BY 1)
SELECT query_id, doc_id, round(sum(weight) / max(total), 6) AS score FROM w JOIN h USING (x) JOIN t USING (query_id) GROUP BY 1, 2 HAVING sum(weight) / max(total) >= 0.3""")
def keyword_idf_score(spark, sf_dir):
    stems = lambda df, key, name: df.select(F.col(key).alias(name), F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("stems"))
    scored = R.keyword_coverage(stems(table(spark, sf_dir, "documents"), "doc_id", "doc_id"), stems(table(spark, sf_dir, "benchmark"), "item_id", "query_id"))
    return scored.where("score >= 0.3").select("query_id", "doc_id", F.round("score", 6).alias("score"))


TRIGGERS = [("east", "the", 1.0), ("east", "tion", 2.0), ("west", "que", 1.5), ("west", "ment", 2.0), ("north", "sch", 2.0), ("north", "ung", 1.0), ("south", "ción", 3.0)]


@query("""
WITH t(domain, trigger, weight) AS (VALUES """ + ", ".join(f"('{d}', '{t}', {w})" for d, t, w in TRIGGERS) + """),
h AS (SELECT conv_id, turn, domain, sum(weight) AS score FROM conversations JOIN t ON contains(lower(text), trigger) GROUP BY 1, 2, 3),
b AS (SELECT *, max(score) OVER (PARTITION BY conv_id, turn) AS best, sum(score) OVER (PARTITION BY conv_id, turn) AS total FROM h)
SELECT conv_id * 1000 + turn AS query_id, domain, CAST(score AS DOUBLE) AS score, round(CAST(best / total AS DOUBLE), 6) AS confidence FROM b WHERE best >= 1 AND score >= 0.6 * best""")
def domain_route(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.lower("text").alias("folded"))
    triggers = spark.createDataFrame(TRIGGERS, "domain string, trigger string, weight double")
    return R.route(turns, triggers).select("query_id", "domain", "score", F.round("confidence", 6).alias("confidence"))


@query("""
WITH e AS (SELECT l_orderkey AS src, l_partkey + 1000000 AS dst FROM lineitem), top AS (SELECT o_custkey AS q, o_orderkey AS node, o_totalprice AS score, row_number() OVER (PARTITION BY o_custkey ORDER BY round(o_totalprice, 9) DESC, o_orderkey) AS rank FROM orders),
r AS (SELECT q, dst AS node, max(score) * 0.4 AS score FROM top JOIN e ON node = src WHERE rank <= 3 GROUP BY 1, 2), n AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY node) AS k FROM r)
SELECT q AS query_id, node, round(score, 4) AS score FROM n WHERE k <= 3""")
def graph_expansion(spark, sf_dir):
    # Orders are nodes under negative numbers, as an order of the same number as a part's node is another node.
    edges = table(spark, sf_dir, "lineitem").select((-1 - F.col("l_orderkey")).alias("src"), (F.col("l_partkey") + 1000000).alias("dst"))
    top = R.ranked(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("node"), F.col("o_totalprice").alias("score")), "query_id", "score", "node", 3).withColumn("node", -1 - F.col("node"))
    return R.graph_neighbours(top, edges).select("query_id", "node", F.round("score", 4).alias("score"))


@query("""
WITH c AS (SELECT p_partkey AS chunk_id, p_name AS title, CAST(p_size AS VARCHAR) || CASE WHEN p_partkey % 3 = 0 THEN '-' || CAST(p_partkey % 9 + 1 AS VARCHAR) ELSE '' END AS article FROM part),
q(query_id, article, hint) AS (VALUES (1, '7', 'red'), (2, '12', NULL), (3, '5', 'no such'), (4, '9-3', 'blue')),
h AS (SELECT query_id, chunk_id, CASE WHEN c.article = q.article THEN 1.2 ELSE 1.0 END AS score, coalesce(contains(lower(title), hint), false) AS hinted FROM c JOIN q ON c.article = q.article OR list_contains(string_split(c.article, '-'), q.article)),
k AS (SELECT *, bool_or(hinted) OVER (PARTITION BY query_id) AS any_hint FROM h), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM k WHERE hinted OR NOT any_hint)
SELECT query_id, chunk_id, CAST(score AS DOUBLE) AS score, rank FROM r WHERE rank <= 10""")
def article_channel(spark, sf_dir):
    size, prime = F.col("p_size").cast("string"), (F.col("p_partkey") % 9 + 1).cast("string")
    chunks = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("chunk_id"), F.col("p_name").alias("title"), F.when(F.col("p_partkey") % 3 == 0, F.concat_ws("-", size, prime)).otherwise(size).alias("article"))
    queries = spark.createDataFrame([(1, "7", "red"), (2, "12", None), (3, "5", "no such"), (4, "9-3", "blue")], "query_id int, article string, hint string")
    return R.article_channel(chunks, queries).select("query_id", "chunk_id", "score", F.col("rank").cast("bigint").alias("rank"))


@query("""
WITH r AS (SELECT source AS query_id, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rank FROM documents),
h AS (SELECT *, rank > 20 AS tail, CASE WHEN rank <= 20 THEN n_chars % 97 END AS s FROM r)
SELECT query_id, doc_id, rank, row_number() OVER (PARTITION BY query_id ORDER BY tail, s DESC NULLS LAST, rank) AS new_rank FROM h""")
def rerank_head(spark, sf_dir):
    placed = R.numbered(table(spark, sf_dir, "documents").select(F.col("source").alias("query_id"), "doc_id", "n_chars"), "query_id", "doc_id")
    again = R.rerank_head(placed, (F.col("n_chars") % 97).cast("double"), 5)
    return again.select("query_id", "doc_id", F.col("rank").cast("bigint").alias("rank"), F.col("new_rank").cast("bigint").alias("new_rank"))


@query(BM25_SQL + "SELECT query_id, round(max(score), 6) AS top_score, max(score) >= 1 / 18 AS confident, CASE WHEN query_id % 2 = 0 THEN round(max(score) * (1 + 0.8 * 0.5), 6) ELSE round(max(score), 6) END AS boosted FROM r WHERE rank <= 10 GROUP BY 1")
def confidence_and_boost(spark, sf_dir):
    top = R.bm25(_tokens(spark, sf_dir), _passages(spark, sf_dir), k=10).groupBy("query_id").agg(F.max("score").alias("top"))
    boost = R.boosted(F.col("top"), F.col("query_id") % 2 == 0, F.lit(0.5))
    return top.select("query_id", F.round("top", 6).alias("top_score"), R.is_confident(F.col("top"), F.lit(False)).alias("confident"), F.round(boost, 6).alias("boosted"))


@query()
def query_expansion(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.col("text").alias("query"), T.fold("text").alias("folded"))
    thesaurus = spark.createDataFrame([("the of", "of the"), ("tion", "action"), ("de la", "of the"), ("und", "and")], "phrase string, term string")
    return R.expand_query(turns, thesaurus).select("query_id", F.size("added").alias("n_added"), F.length("query").alias("size"))
