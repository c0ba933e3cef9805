"""Queries of sections, chunks, versions of text, privacy and data quality."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillmesh.operators import chunking as C
from quillmesh.operators import parsing as PA
from quillmesh.operators import privacy as PR
from quillmesh.operators import quality as Q
from quillmesh.operators import versions as V
from quillmesh.plans.base import Registry, table

REGISTRY = Registry()
query = REGISTRY.query
LINES = "SELECT doc_id, unnest(r) AS line, generate_subscripts(r, 1) - 1 AS pos FROM (SELECT doc_id, string_split(text, chr(10)) AS r FROM documents)"
HEADING = "length(line) BETWEEN 1 AND 30"


def _lines(spark, sf_dir):
    return C.lines_of(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query(f"WITH l AS ({LINES}), s AS (SELECT *, {HEADING} AS h, sum(CASE WHEN {HEADING} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS section FROM l) SELECT doc_id, CAST(section AS BIGINT) AS section, max(CASE WHEN h THEN line END) AS title, md5(coalesce(string_agg(CASE WHEN NOT h THEN line END, chr(10) ORDER BY pos), '')) AS body FROM s GROUP BY 1, 2")
def line_sections(spark, sf_dir):
    sections = C.section_texts(C.carried_sections(_lines(spark, sf_dir), F.length("line").between(1, 30)))
    return sections.select("doc_id", F.col("section").cast("bigint").alias("section"), "title", F.md5("body").alias("body"))


@query(f"WITH l AS ({LINES}) SELECT doc_id, CAST(pos AS BIGINT) AS pos, CAST(2 * len(list_filter(regexp_split_to_array(line, '\\s+'), lambda x: x <> '')) AS BIGINT) AS tokens FROM l")
def paragraph_chunks(spark, sf_dir):
    tokens = F.size(F.filter(F.split("line", r"\s+", -1), lambda x: x != "")) * 2
    return _lines(spark, sf_dir).select("doc_id", F.col("pos").cast("bigint").alias("pos"), tokens.cast("bigint").alias("tokens"))


@query(f"""
WITH l AS (SELECT *, length(line) AS tokens, length(line) < 100 AS tiny FROM ({LINES})), j AS (SELECT *, tiny AND coalesce(lag(tiny) OVER (PARTITION BY doc_id ORDER BY pos), false) AS joins FROM l),
i AS (SELECT *, sum(CASE WHEN joins THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM j)
SELECT doc_id, CAST(island AS BIGINT) AS island, CAST(min(pos) AS BIGINT) AS pos, count(*) AS merged, CAST(sum(tokens) AS BIGINT) AS tokens, md5(string_agg(line, chr(10) ORDER BY pos)) AS content FROM i GROUP BY 1, 2""")
def tiny_merge_islands(spark, sf_dir):
    chunks = _lines(spark, sf_dir).select("doc_id", "pos", F.length("line").alias("tokens"), F.col("line").alias("content"))
    merged = C.merge_tiny(chunks, ["doc_id"], [])
    return merged.select("doc_id", F.col("island").cast("bigint").alias("island"), F.col("pos").cast("bigint").alias("pos"), "merged", F.col("tokens").cast("bigint").alias("tokens"), F.md5("content").alias("content"))


@query(f"WITH l AS ({LINES}), k AS (SELECT doc_id, pos, lower(left(line, 8)) AS id, row_number() OVER (PARTITION BY doc_id, lower(left(line, 8)) ORDER BY pos) AS k FROM l) SELECT doc_id, CAST(pos AS BIGINT) AS pos, CASE WHEN k = 1 THEN id ELSE id || '#' || k END AS chunk_id, k AS occurrence FROM k")
def unique_chunk_ids(spark, sf_dir):
    chunks = _lines(spark, sf_dir).select("doc_id", "pos", F.lower(F.left("line", F.lit(8))).alias("chunk_id"))
    numbered = C.occurrences(chunks.withColumn("base", F.col("chunk_id")), ["doc_id", "base"])
    return C.unique_ids(numbered, ["doc_id"]).select("doc_id", F.col("pos").cast("bigint").alias("pos"), "chunk_id", F.col("occurrence").cast("bigint").alias("occurrence"))


@query("""
WITH e AS (SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS pos, l_partkey % 4 AS lv, 't' || l_suppkey AS title FROM lineitem),
p AS (SELECT *, max(CASE WHEN lv = 0 THEN pos END) OVER w AS p0, max(CASE WHEN lv = 1 THEN pos END) OVER w AS p1, max(CASE WHEN lv = 2 THEN pos END) OVER w AS p2 FROM e WINDOW w AS (PARTITION BY doc_id ORDER BY pos))
SELECT p.doc_id, p.pos, concat_ws('/', a.title, CASE WHEN p1 > coalesce(p0, 0) THEN b.title END, CASE WHEN p2 > greatest(coalesce(p0, 0), coalesce(p1, 0)) THEN c.title END) AS path FROM p
LEFT JOIN e a ON a.doc_id = p.doc_id AND a.pos = p0 LEFT JOIN e b ON b.doc_id = p.doc_id AND b.pos = p1 LEFT JOIN e c ON c.doc_id = p.doc_id AND c.pos = p2""")
def hierarchy_paths(spark, sf_dir):
    level = F.element_at(F.array(*[F.lit(x) for x in ("part", "section", "subsection", "article")]), (F.col("l_partkey") % 4 + 1).cast("int"))
    pos = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    elements = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), pos.alias("pos"), level.alias("level"), F.concat(F.lit("t"), F.col("l_suppkey").cast("string")).alias("title"))
    return C.hierarchy_paths(elements).select("doc_id", F.col("pos").cast("bigint").alias("pos"), F.array_join("path", "/").alias("path"))


@query(f"WITH l AS ({LINES}) SELECT doc_id, CAST(pos AS BIGINT) AS pos, left(regexp_replace(regexp_replace(lower(line), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 60) AS slug FROM l")
def chunk_slugs(spark, sf_dir):
    return _lines(spark, sf_dir).select("doc_id", F.col("pos").cast("bigint").alias("pos"), F.left(C.slug(F.col("line")), F.lit(60)).alias("slug"))


@query()
def oversized_pieces(spark, sf_dir):
    pieces = C.split_oversized(table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content")), "doc_id", most=4000, overlap=400)
    return pieces.select("doc_id", "piece", F.length("content").alias("size"))


@query()
def sized_chunks(spark, sf_dir):
    articles = table(spark, sf_dir, "documents").select("doc_id", F.lit(0).alias("pos"), F.lit("1").alias("article"), F.col("text").alias("content"), (F.size(F.split("text", r"\s+", -1)) * 2).alias("tokens"))
    numbered = articles.withColumn("content", F.regexp_replace("content", r"\n([A-ZÀ-Ý])", "\n1. $1"))
    return C.size_branches(numbered, r"(?m)^(\d+)\. ", r"(?m)(?:^|; )(\w)\) ").select("doc_id", "chunk_id", F.length("content").alias("size"))


@query()
def numbered_points(spark, sf_dir):
    return C.points(_lines(spark, sf_dir), F.col("line").rlike("^[A-ZÀ-Ý]")).select("doc_id", F.col("kept").alias("point"), "joined", F.length("text").alias("size"))


@query("""SELECT doc_id, CAST(len(regexp_extract_all(text, '\\b[0-9A-Za-z_.+-]+@[0-9A-Za-z_-]+\\.[0-9A-Za-z_.]{2,}\\b')) AS BIGINT) AS email, CAST(len(regexp_extract_all(text, '\\b\\d{4}[\\s-]?\\d{4}[\\s-]?\\d{4}[\\s-]?\\d{4}\\b')) AS BIGINT) AS card, CAST(len(regexp_extract_all(text, '\\b\\d{14}\\b')) AS BIGINT) AS person_number, CAST(len(regexp_extract_all(text, '\\b\\d{20}\\b')) AS BIGINT) AS account FROM documents""")
def pii_counts(spark, sf_dir):
    found = PR.counts(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", *[found[c].cast("bigint").alias(c) for c in ("email", "card", "person_number", "account")])


@query("""WITH c AS (SELECT source, len(regexp_extract_all(text, '\\b[0-9A-Za-z_.+-]+@[0-9A-Za-z_-]+\\.[0-9A-Za-z_.]{2,}\\b')) + len(regexp_extract_all(text, '\\b\\d{4}[\\s-]?\\d{4}[\\s-]?\\d{4}[\\s-]?\\d{4}\\b')) AS n FROM documents) SELECT source, count(*) AS n_docs, count(CASE WHEN n > 0 THEN 1 END) AS n_quarantined, round(avg(CASE WHEN n > 0 THEN 1.0 ELSE 0 END), 6) AS rate FROM c GROUP BY 1""")
def pii_quarantine_rate(spark, sf_dir):
    found = PR.counts(F.col("text"))
    hit = (found["email"] + found["card"]) > 0
    return table(spark, sf_dir, "documents").select("source", hit.alias("hit")).groupBy("source").agg(F.count("*").alias("n_docs"), F.count_if("hit").alias("n_quarantined"), F.round(F.avg(F.when(F.col("hit"), 1.0).otherwise(0.0)), 6).alias("rate"))


@query()
def pii_redact(spark, sf_dir):
    done = PR.redacted(table(spark, sf_dir, "documents"))
    return done.select("doc_id", F.length("redacted").alias("size"), "n_redactions", "quarantine")


VALIDATION = """
WITH d AS (SELECT doc_id, text, lang, source, n_chars, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS k FROM documents),
f AS (SELECT doc_id, 'EMPTY' AS code, 'error' AS severity FROM d WHERE length(trim(text)) < 20
UNION ALL SELECT doc_id, 'LONG', 'warning' FROM d WHERE length(trim(text)) >= 20 AND n_chars > 20000
UNION ALL SELECT doc_id, 'DUPLICATE', 'error' FROM d WHERE length(trim(text)) >= 20 AND k > 1
UNION ALL SELECT doc_id, 'PII', 'error' FROM d WHERE length(trim(text)) >= 20 AND regexp_matches(text, '[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+\\.[A-Za-z0-9_.]{2,}')
UNION ALL SELECT doc_id, 'SIZE', 'warning' FROM d WHERE length(trim(text)) >= 20 AND n_chars <> length(text))
"""


def _validated(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("k", F.row_number().over(Window.partitionBy(F.md5("text")).orderBy("doc_id")))
    rules = [
        ("EMPTY", "error", F.length(F.trim("text")) < 20),
        ("LONG", "warning", F.col("n_chars") > 20000),
        ("DUPLICATE", "error", F.col("k") > 1),
        ("PII", "error", F.col("text").rlike(r"[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+\.[A-Za-z0-9_.]{2,}")),
        ("SIZE", "warning", F.col("n_chars") != F.length("text")),
    ]
    return Q.findings(docs, ["doc_id"], rules, last="EMPTY")


@query(VALIDATION + "SELECT doc_id, code, severity FROM f")
def validation_findings(spark, sf_dir):
    return _validated(spark, sf_dir)


@query(VALIDATION + "SELECT code, severity, count(*) AS n, count(DISTINCT doc_id) AS n_keys FROM f GROUP BY 1, 2")
def validation_summary(spark, sf_dir):
    return Q.summary(_validated(spark, sf_dir), ["doc_id"])


@query("SELECT reason, count(*) AS n FROM (SELECT CASE WHEN n_chars < 50 THEN 'short' WHEN lang NOT IN ('en', 'fr') THEN 'language' WHEN n_chars > 10000 THEN 'long' ELSE 'kept' END AS reason FROM documents) GROUP BY 1")
def sample_filter(spark, sf_dir):
    reason = Q.first_reason([("short", F.col("n_chars") < 50), ("language", ~F.col("lang").isin("en", "fr")), ("long", F.col("n_chars") > 10000)])
    return table(spark, sf_dir, "documents").groupBy(F.coalesce(reason, F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@query("SELECT source, count(*) AS n_docs, count(DISTINCT lang) AS n_langs, CAST(sum(n_chars) AS BIGINT) AS n_chars, count(DISTINCT md5(text)) AS n_texts, round(avg(CASE WHEN n_chars > 1000 THEN 1.0 ELSE 0 END), 6) AS long_share FROM documents GROUP BY 1")
def corpus_health(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n_docs"), F.countDistinct("lang").alias("n_langs"), F.sum("n_chars").alias("n_chars"), F.countDistinct(F.md5("text")).alias("n_texts"), F.round(F.avg(F.when(F.col("n_chars") > 1000, 1.0).otherwise(0.0)), 6).alias("long_share"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN strftime(o_orderdate + INTERVAL 30 DAY, '%Y-%m-%d') <= '1998-06-01' THEN strftime(o_orderdate + INTERVAL 30 DAY, '%Y-%m-%d') END AS valid_from FROM orders")
def valid_from_backfill(spark, sf_dir):
    iso = lambda c: F.date_format(c, "yyyy-MM-dd")
    return table(spark, sf_dir, "orders").select("o_orderkey", V.valid_from_or_adopted(F.when(F.col("o_orderkey") % 5 == 0, iso("o_orderdate")), iso(F.date_add("o_orderdate", 30)), "1998-06-01").alias("valid_from"))


@query("SELECT p_partkey, CASE WHEN p_name LIKE '%kodeks%' THEN 'kodeks' ELSE 'boshqa' END AS kind, '[' || p_name || ' > ' || p_brand || ' > ' || p_size || '-modda]' AS heading FROM part")
def chunk_headings(spark, sf_dir):
    label = C.heading(F.col("p_name"), F.array("p_brand"), F.concat(F.col("p_size").cast("string"), F.lit("-modda")), F.lit(""))
    return table(spark, sf_dir, "part").select("p_partkey", PA.first_matching(F.col("p_name"), PA.DOCUMENT_TYPES, "boshqa").alias("kind"), label.alias("heading"))


@query()
def note_signals(spark, sf_dir):
    """Amendment notes written from the orders' fields, read back."""
    day = F.date_format("o_orderdate", "dd.MM.yyyy")
    said = F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("("), (F.col("o_orderkey") % 90 + 1).cast("string"), F.lit("-modda oʻz kuchini yoʻqotgan, kuchini yoʻqotish sanasi — "), day, F.lit(")"))).otherwise(F.concat(F.lit("("), (F.col("o_orderkey") % 90 + 1).cast("string"), F.lit(" va 95-moddalar Oʻzbekiston Respublikasining "), day, F.lit(" OʻRQ-"), F.col("o_custkey").cast("string"), F.lit("-sonli Qonuni tahririda)")))
    notes = table(spark, sf_dir, "orders").select("o_orderkey", said.alias("text"), F.lit("7").alias("fallback"))
    return V.parse_notes(notes).select("o_orderkey", "kind", F.array_join("targets", ",").alias("targets"), "effective_date", "amending_act")
