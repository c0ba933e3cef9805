"""Queries of coverage, lookups, gold and suite checks, and of text rules, over rows written from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmesh.functions import text as T
from quillmesh.operators import claims as G
from quillmesh.operators import coverage as C
from quillmesh.operators import quality as Q
from quillmesh.operators import retrieval as R
from quillmesh.operators import versions as V
from quillmesh.plans.base import Registry, table

REGISTRY = Registry()
query = REGISTRY.query
APOSTROPHES = "[''‘’ʻʼ`´′]"


def _pick(column: str, values: list[str]):
    """One of the values by the remainder of a key."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.col(column) % len(values) + 1).cast("int"))


def _listed(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


ASKED = ["AQSh qonuni nima deydi", "GDPR talablari", "Rossiya haqida", "Plenum qarori bormi", "hokimning qarori kuchga kirdimi", "xalqaro shartnoma bormi", "vazirlikning buyrugʻi", "mehnat shartnomasi", " "]


@query(f"""
WITH n AS (SELECT count(CASE WHEN p_partkey % 100 = 0 THEN 1 END) AS plenum, count(CASE WHEN p_partkey % 20 = 1 THEN 1 END) AS hokim FROM part), a AS (SELECT c_custkey, {_listed(ASKED)}[CAST(c_custkey % 9 + 1 AS INT)] AS question, c_custkey % 9 AS r FROM customer)
SELECT c_custkey, question, CASE WHEN r IN (0, 1) THEN 'yurisdiksiya' WHEN r = 3 AND plenum < 10 OR r = 4 AND hokim < 10 OR r IN (5, 6) THEN 'manba-turi' END AS kind,
  CASE WHEN r = 0 THEN 'AQSh' WHEN r = 1 THEN 'Yevropa Ittifoqi (GDPR)' WHEN r = 3 AND plenum < 10 THEN 'Oliy sud Plenumi qarorlari' WHEN r = 4 AND hokim < 10 THEN 'hokim qarorlari' WHEN r = 5 THEN 'xalqaro shartnoma va konvensiyalar' WHEN r = 6 THEN 'vazirlik buyruqlari' END AS subject FROM a, n""")
def coverage_gate(spark, sf_dir):
    documents = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.when(F.col("p_partkey") % 20 == 1, "Hokimning qarori").otherwise("Mehnat kodeksi").alias("title"), F.when(F.col("p_partkey") % 100 == 0, "plenum").otherwise("kodeks").alias("doc_type"))
    return C.coverage_gaps(table(spark, sf_dir, "customer").select("c_custkey", _pick("c_custkey", ASKED).alias("question")), documents)


@query("SELECT c_custkey AS question_id, CASE WHEN c_custkey % 4 = 1 THEN 'raqamli aktivlar kodeksi' ELSE 'kosmos kodeksi' END AS document FROM customer WHERE c_custkey % 4 IN (1, 3)")
def missing_documents(spark, sf_dir):
    questions = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("question_id"), _pick("c_custkey", ["Mehnat kodeksi 5-modda", "raqamli aktivlar kodeksi", "Oila kodeksi", "yangi kosmos kodeksi"]).alias("question"))
    return C.missing_documents(questions, table(spark, sf_dir, "part").select(_pick("p_partkey", ["Oʻzbekiston Mehnat kodeksi", "Oila kodeksi"]).alias("title")).distinct())


def _articles(spark, sf_dir):
    return table(spark, sf_dir, "part").select(_pick("p_partkey", ["Oʻzbekiston Mehnat kodeksi", "Oila kodeksi"]).alias("title"), F.col("p_size").cast("string").alias("article"))


@query("""
WITH q AS (SELECT c_custkey AS question_id, CAST(c_custkey % 80 + 1 AS VARCHAR) AS article, c_custkey % 3 = 0 AS hinted FROM customer), c AS (SELECT DISTINCT CAST(p_size AS VARCHAR) AS article, p_partkey % 2 = 0 AS labour FROM part)
SELECT question_id, article FROM q WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.article = q.article AND (NOT hinted OR labour))""")
def missing_articles(spark, sf_dir):
    number = (F.col("c_custkey") % 80 + 1).cast("string")
    questions = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("question_id"), F.concat(F.when(F.col("c_custkey") % 3 == 0, "mehnat kodeksi ").otherwise(""), number, F.lit("-modda nima")).alias("question"))
    return C.missing_articles(questions, _articles(spark, sf_dir))


CHUNKS = "SELECT l_orderkey % 50 AS doc_id, CAST(l_partkey % 30 AS VARCHAR) AS article, CAST(l_suppkey % 5 AS VARCHAR) AS element_id, CAST(l_linenumber AS VARCHAR) AS part, ((l_orderkey * 8 + l_linenumber) * 1000000 + l_partkey) * 10000 + l_suppkey AS pos FROM lineitem"


def _chunks(spark, sf_dir):
    c = F.col
    pos = ((c("l_orderkey") * 8 + c("l_linenumber")) * 1_000_000 + c("l_partkey")) * 10_000 + c("l_suppkey")
    return table(spark, sf_dir, "lineitem").select((c("l_orderkey") % 50).alias("doc_id"), (c("l_partkey") % 30).cast("string").alias("article"), (c("l_suppkey") % 5).cast("string").alias("element_id"), c("l_linenumber").cast("string").alias("part"), F.lit(None).cast("string").alias("item"), pos.alias("pos"), pos.alias("chunk_id"))


@query(f"WITH c AS ({CHUNKS}), f AS (SELECT *, first_value(element_id) OVER (PARTITION BY doc_id, article ORDER BY pos) AS e FROM c) SELECT doc_id, article, pos AS chunk_id, n FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, article ORDER BY part, pos) AS n FROM f WHERE element_id = e) WHERE n <= 4")
def article_chunks(spark, sf_dir):
    return C.article_chunks(_chunks(spark, sf_dir)).select("doc_id", "article", "chunk_id", F.col("n").cast("bigint").alias("n"))


@query(f"SELECT doc_id, article, count(DISTINCT element_id) AS n FROM ({CHUNKS}) GROUP BY 1, 2")
def article_variants(spark, sf_dir):
    return C.article_variants(_chunks(spark, sf_dir))


@query(f"SELECT doc_id, count(*) AS n FROM (SELECT doc_id, article FROM ({CHUNKS}) GROUP BY 1, 2 HAVING count(DISTINCT element_id) > 1) GROUP BY 1")
def ambiguous_articles(spark, sf_dir):
    return C.ambiguous_articles(_chunks(spark, sf_dir))


@query(f"SELECT doc_id, string_agg(DISTINCT article, ',' ORDER BY article) AS labels FROM ({CHUNKS}) GROUP BY 1")
def article_labels(spark, sf_dir):
    return C.article_labels(_chunks(spark, sf_dir)).select("doc_id", F.array_join("labels", ",").alias("labels"))


@query("""
WITH p AS (SELECT a.vec_id AS vec_id, 0.7 * list_cosine_similarity(list_transform(a.embedding, lambda x: CAST(x AS DOUBLE)), list_transform(b.embedding, lambda x: CAST(x AS DOUBLE))) + 0.3 * (a.vec_id % 10 / 10) + CASE WHEN a.label = b.label THEN 0.5 ELSE 0 END AS score FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)
SELECT vec_id, round(score, 4) AS score FROM p WHERE score >= 0.25""")
def local_hybrid_score(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    after = vectors.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"), F.col("label").alias("other_label"))
    score = C.hybrid_score(R.cosine("embedding", "other"), (F.col("vec_id") % 10) / 10, F.col("label") == F.col("other_label"))
    return vectors.join(after, "vec_id").select("vec_id", score.alias("score")).where("score >= 0.25").select("vec_id", F.round("score", 4).alias("score"))


@query("SELECT doc_id, 'C' || doc_id AS tag, md5(left(text, 600)) AS excerpt, CASE doc_id % 4 WHEN 1 THEN 'repealed' WHEN 2 THEN 'pending' ELSE 'in_force' END AS status FROM documents")
def citations(spark, sf_dir):
    made = C.citation(F.concat(F.lit("c"), F.col("doc_id").cast("string")), F.col("source"), F.lit(None).cast("string"), F.col("text"), _pick("doc_id", ["in_force", "repealed", "pending", "unknown"]))
    return table(spark, sf_dir, "documents").select("doc_id", made.alias("c")).select("doc_id", "c.tag", F.md5("c.excerpt").alias("excerpt"), "c.status")


@query("SELECT topic, chunk_id, query_no, rank FROM (SELECT o_custkey AS topic, o_orderkey % 7 AS chunk_id, o_orderkey % 3 AS query_no, o_orderkey AS rank, row_number() OVER (PARTITION BY o_custkey, o_orderkey % 7 ORDER BY o_orderkey % 3, o_orderkey) AS n FROM orders) WHERE n = 1")
def collected_norms(spark, sf_dir):
    key = F.col("o_orderkey")
    return C.collected_norms(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("topic"), (key % 7).alias("chunk_id"), (key % 3).alias("query_no"), key.alias("rank")))


@query("SELECT event_id, CASE WHEN event_id % 9 + 1 = 5 THEN '' ELSE CAST(event_id % 9 + 1 AS VARCHAR) END AS invented FROM events")
def unsupported_articles(spark, sf_dir):
    answer = F.concat((F.col("event_id") % 9 + 1).cast("string"), F.lit("-modda va 5-modda asosida"))
    return table(spark, sf_dir, "events").select("event_id", F.array_join(C.unsupported_articles(answer, F.array(F.lit("5"))), ",").alias("invented"))


QUERIES = ["qisqa savol", "mehnat shartnomasi qachon bekor qilinadi", "mehnat kodeksining 5-modda nima haqida deydi", "oila kodeksi boʻyicha nikoh qachon tugaydi"]


@query(f"""
WITH k AS (SELECT c_custkey AS pos, 'c' || (CASE WHEN c_custkey % 7 = 1 THEN c_custkey - 1 ELSE c_custkey END) AS id, c_custkey % 4 AS q, c_custkey % 5 = 0 AS lookup, c_custkey % 6 = 0 AS none, CAST(c_custkey % 70 + 1 AS VARCHAR) AS want, c_custkey % 3 = 0 AS hinted FROM customer),
c AS (SELECT DISTINCT CAST(p_size AS VARCHAR) AS article, p_partkey % 2 = 0 AS labour FROM part), n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pos) > 1 AS again, EXISTS (SELECT 1 FROM c WHERE article = want AND (NOT hinted OR labour)) AS held FROM k)
SELECT pos, id, CASE WHEN again THEN 'identifikator takrorlangan' WHEN NOT lookup AND q = 0 THEN 'savol juda qisqa' WHEN NOT lookup AND q = 2 THEN 'savolda modda raqami bor' WHEN none THEN 'kutilgan modda ko''rsatilmagan' WHEN NOT held THEN 'kutilgan modda korpusda yo''q' END AS issue FROM n""")
def gold_issues(spark, sf_dir):
    k = F.col("c_custkey")
    want = F.when(k % 6 != 0, F.array((k % 70 + 1).cast("string"))).otherwise(F.array().cast("array<string>"))
    cases = table(spark, sf_dir, "customer").select(k.alias("pos"), F.concat(F.lit("c"), F.when(k % 7 == 1, k - 1).otherwise(k).cast("string")).alias("id"), _pick("c_custkey", QUERIES).alias("query"), want.alias("expected_articles"), F.when(k % 3 == 0, "Mehnat").alias("doc_hint"), F.when(k % 5 == 0, "modda-lookup").otherwise("mehnat").alias("category"))
    return C.gold_issues(cases, _articles(spark, sf_dir))


ANSWERS = ["Mehnat kodeksi 5-modda", "Topilmadi", "", "Uzoq javob bu yerda juda koʻp soʻz bor"]
SUITE_SQL = """
WITH s AS (SELECT c_custkey AS k, c_custkey % 4 AS a, c_custkey % 6 = 1 AS refuse, c_custkey % 3 AS gate_dropped, 2 AS gate_kept, c_custkey % 2 = 0 AS wants, c_custkey % 8 = 0 AS cited, c_custkey % 10 < 5 AS found, c_mktsegment AS category FROM customer),
p AS (SELECT *, NOT refuse OR a = 1 AS ok_refusal, NOT (k % 5 = 0 AND a = 1) AS ok_forbid, refuse OR CASE WHEN k % 3 = 0 THEN a = 0 ELSE a = 3 END AS ok_expect, refuse OR NOT wants OR cited AS ok_articles, refuse OR k % 7 <> 0 OR a IN (1, 2) OR a = 0 AND false OR a = 0 AND 3 >= 3 AS ok_length FROM s),
o AS (SELECT *, ok_refusal AND ok_forbid AND ok_expect AND ok_articles AND ok_length AS passed FROM p),
d AS (SELECT *, CASE WHEN passed THEN '—' WHEN NOT ok_articles THEN CASE WHEN found AND gate_dropped > 0 THEN 'gate' ELSE 'retrieval' END WHEN gate_dropped > 0 AND a = 2 THEN 'gate' ELSE 'model' END AS diagnosis FROM o)
"""


def _suite(spark, sf_dir):
    k = F.col("c_custkey")
    texts = lambda *xs: F.array(*[F.lit(x) for x in xs])
    none = F.array().cast("array<string>")
    cases = table(spark, sf_dir, "customer").select(
        k.alias("case_id"), F.col("c_mktsegment").alias("category"), _pick("c_custkey", ANSWERS).alias("answer"), (k % 4 == 1).alias("refused"), (k % 6 == 1).alias("expect_refusal"),
        F.when(k % 3 == 0, F.array(texts("mehnat", "oila"), texts("Modda"))).otherwise(F.array(texts("javob"))).alias("expect_any"), F.when(k % 5 == 0, texts("topilmadi")).otherwise(none).alias("forbid"),
        F.when(k % 2 == 0, texts("5")).otherwise(none).alias("expect_articles"), F.when(k % 8 == 0, texts("5")).otherwise(none).alias("cited"), F.when(k % 10 < 5, texts("5", "6")).otherwise(texts("7")).alias("retrieved"),
        (k % 3).alias("gate_dropped"), F.lit(2).alias("gate_kept"), F.when(k % 7 == 0, 3).alias("max_words"),
    )
    return C.suite_outcomes(cases)


@query(SUITE_SQL + "SELECT k AS case_id, passed, diagnosis FROM d")
def suite_outcomes(spark, sf_dir):
    return _suite(spark, sf_dir).select("case_id", "passed", "diagnosis")


@query(SUITE_SQL + "SELECT category, count(*) AS n, round(avg(CASE WHEN passed THEN 1.0 ELSE 0 END), 6) AS pass_rate, round(sum(gate_dropped) / sum(gate_dropped + gate_kept), 6) AS drop_rate FROM d GROUP BY 1")
def suite_report(spark, sf_dir):
    return C.suite_report(_suite(spark, sf_dir), "category")


@query("""
WITH m AS (SELECT event_type AS metric, avg(value) AS value FROM events GROUP BY 1), t(metric, target, at_least) AS (VALUES ('click', 50.0, true), ('view', 40.0, false), ('none', 1.0, true))
SELECT t.metric, round(value, 4) AS value, CAST(target AS DOUBLE) AS target, coalesce(CASE WHEN at_least THEN value >= target ELSE value <= target END, false) AS met FROM t LEFT JOIN m ON t.metric = m.metric""")
def metric_targets(spark, sf_dir):
    metrics = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("metric")).agg(F.avg("value").alias("value"))
    targets = spark.createDataFrame([("click", 50.0, True), ("view", 40.0, False), ("none", 1.0, True)], "metric string, target double, at_least boolean")
    return C.against_targets(metrics, targets).withColumn("value", F.round("value", 4))


ENGLISH, UZBEK = (_listed(words) for words in (T.P.ENGLISH_DICTIONARY, T.P.UZBEK_DICTIONARY))


@query(f"""
WITH w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(lower(regexp_replace(text, '{APOSTROPHES}', '', 'g')), '[^\\p{{L}}'']+'), lambda x: x <> '') AS t FROM documents),
n AS (SELECT doc_id, text, len(list_filter(t, lambda x: list_contains({ENGLISH}, x))) AS en, len(list_filter(t, lambda x: list_contains({UZBEK}, x))) + len(regexp_extract_all(text, '[oO][''ʻ]|[gG][''ʻ]')) + 0.5 * len(regexp_extract_all(text, '(?i)\\b\\w*(ning|ga|dan|da|lar|ymiz|siz)\\b')) + 0.2 * len(regexp_extract_all(text, '[qxQX]')) AS uz FROM w)
SELECT doc_id, CASE WHEN trim(text) = '' OR uz > en THEN 'uz' WHEN en > 0 THEN 'en' ELSE 'uz' END AS lang, 'latn' AS script FROM n""")
def detected_languages(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.language_of("text").alias("l")).select("doc_id", "l.lang", "l.script")


@query(f"SELECT conv_id, turn, CAST(len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[oOgG][''‘’`´′ʼ]'))) AS BIGINT) AS findings FROM conversations")
def lint_findings(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(T.lint_lines("text")).cast("bigint").alias("findings"))


@query()
def cyrillic_round_trip(spark, sf_dir):
    """Texts in Cyrillic letters and back: what the letters lose is the same each time; a test compares with a table of pairs."""
    made = T.to_cyrillic("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(made).alias("cyrillic"), F.md5(T.to_latin(made)).alias("latin"))


@query(f"SELECT doc_id, md5(lower(regexp_replace(text, '{APOSTROPHES}', '', 'g'))) AS folded FROM documents")
def web_fold(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.fold_without_apostrophes("text")).alias("folded"))


def _stem_sql(word: str) -> str:
    return "CASE " + " ".join(f"WHEN {word} LIKE '%{s}' AND length({word}) - {len(s)} >= 3 THEN left({word}, length({word}) - {len(s)})" for s in T.P.SUFFIXES) + f" ELSE {word} END"


@query(f"WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents), a AS (SELECT word, {_stem_sql('word')} AS once FROM w) SELECT word, {_stem_sql('once')} AS stem FROM a")
def stems_twice(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word")).distinct()
    return words.select("word", T.stem_twice("word").alias("stem"))


@query("""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[ \\t]+([,.;:!?])', '\\1', 'g'), '(?i)(\\d+)\\s*-\\s*(modda|band|qism)', '\\1-\\2', 'g'), '[ \\t]{2,}', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), '(?m)[ \\t]+$', '', 'g'), '^[\\s\\x{00A0}]+|[\\s\\x{00A0}]+$', '', 'g')) AS polished FROM documents""")
def polished_texts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.polished("text")).alias("polished"))


@query("""
WITH n AS (SELECT doc_id, greatest(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')), 1) AS total, len(list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'), lambda x: x IN ('the', 'and'))) AS hits FROM documents)
SELECT doc_id, round(greatest(0.0, least(1.0, 1 - 2 * hits / total)), 5) AS purity FROM n""")
def purity_scores(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.round(T.language_purity("text", ["the", "and"]), 5).alias("purity"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN CASE WHEN o_orderkey % 3 = 0 THEN 'eski;qisman' ELSE 'eski' END WHEN o_orderkey % 3 = 0 THEN 'qisman' ELSE '' END AS caveats FROM orders")
def answer_caveats(spark, sf_dir):
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(G.caveats([(k % 2 == 0, "eski"), (k % 3 == 0, "qisman"), (k % 6 == 0, "eski")]), ";").alias("caveats"))


@query("SELECT o_orderkey, 'kuchli' || CASE WHEN o_orderkey % 2 = 0 THEN ',zaif' ELSE '' END AS strengths, 'C' || (o_orderkey % 9 + 1) AS first_tags FROM orders")
def argument_strengths(spark, sf_dir):
    k = F.col("o_orderkey")
    said = F.concat_ws("\n", F.concat(F.lit("[kuchli] Dalil bor. Asos: [C"), (k % 9 + 1).cast("string"), F.lit("]")), F.when(k % 2 == 0, "- [zaif] Shubhali. Asos: [C2]"), F.lit("boshqa qator"))
    read = table(spark, sf_dir, "orders").select("o_orderkey", G.argument_lines(said).alias("a"))
    return read.select("o_orderkey", F.array_join(F.transform("a", lambda x: x["strength"]), ",").alias("strengths"), F.array_join(F.get("a", F.lit(0))["tags"], ",").alias("first_tags"))


@query("SELECT c_custkey, round(least(1.0, greatest(0.0, coalesce(CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_acctbal / 1000 END, 0))), 6) AS clamped FROM customer")
def clamped_confidence(spark, sf_dir):
    said = F.when(F.col("c_custkey") % 3 == 0, "nomalum").otherwise((F.col("c_acctbal") / 1000).cast("string"))
    return table(spark, sf_dir, "customer").select("c_custkey", F.round(Q.clamp(said), 6).alias("clamped"))


VERSIONS = "SELECT o_orderkey AS doc_id, strftime(o_orderdate, '%Y-%m-%d') AS valid_from, CASE WHEN o_orderstatus = 'F' AND o_orderkey % 3 <> 0 THEN strftime(o_orderdate + INTERVAL 30 DAY, '%Y-%m-%d') END AS valid_to, CASE WHEN o_orderstatus = 'F' THEN 'repealed' ELSE 'in_force' END AS status FROM orders"


def _versions(spark, sf_dir):
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    ended = F.col("o_orderstatus") == "F"
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), day("o_orderdate").alias("valid_from"), F.when(ended & (F.col("o_orderkey") % 3 != 0), day(F.date_add("o_orderdate", 30))).alias("valid_to"), F.when(ended, "repealed").otherwise("in_force").alias("status"))


@query(f"WITH v AS ({VERSIONS}), e AS (SELECT DISTINCT l_orderkey AS doc_id FROM lineitem) SELECT doc_id, valid_from, valid_to, coalesce(status, 'in_force') AS status FROM e LEFT JOIN v USING (doc_id)")
def versions_applied(spark, sf_dir):
    return V.apply_versions(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id")).distinct(), _versions(spark, sf_dir), ["doc_id"])


@query(f"WITH v AS ({VERSIONS}) SELECT doc_id, valid_from, valid_to, status FROM v WHERE valid_to IS NOT NULL AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = doc_id AND l_linenumber = 1)")
def repealed_absent(spark, sf_dir):
    present = table(spark, sf_dir, "lineitem").where("l_linenumber = 1").select(F.col("l_orderkey").alias("doc_id")).distinct()
    return V.repealed_absent(_versions(spark, sf_dir), present, ["doc_id"])
