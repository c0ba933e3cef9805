"""Queries of draft answers, element checks, settings, sessions, hierarchies and the cached graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmesh.functions import text as T
from quillmesh.operators import access as AC
from quillmesh.operators import claims as G
from quillmesh.operators import coverage as C
from quillmesh.operators import court as CT
from quillmesh.operators import drafts as D
from quillmesh.operators import graph as GR
from quillmesh.operators import metrics as M
from quillmesh.operators import quality as Q
from quillmesh.plans.base import Registry, table
from quillmesh.sources import folders as FO
from quillmesh.sources import graph_cache as GC
from quillmesh.sources import store

REGISTRY = Registry()
query = REGISTRY.query

POS = "((l_orderkey * 8 + l_linenumber) * 1000000 + l_partkey) * 10000 + l_suppkey"  # line numbers repeat within an order
ROLE = "['jurist', 'advocate', 'prosecutor', 'professor', 'judge'][CAST(l_linenumber % 5 + 1 AS INT)]"


def _role():
    return F.element_at(F.array(*[F.lit(r) for r in D.ROLES["complex"]]), (F.col("l_linenumber") % 5 + 1).cast("int"))


@query(f"""
WITH p AS (SELECT l_orderkey AS request_id, {POS} AS place, {ROLE} AS role, {POS} AS round, concat_ws(chr(10) || chr(10), upper({ROLE}) || ' POZITSIYASI' || chr(10) || 'stance ' || l_partkey,
    CASE WHEN l_quantity > 25 THEN 'DALILLAR' || chr(10) || '- [kuchli] claim ' || l_suppkey || ' [C' || l_linenumber || '] [C9]' END, CASE WHEN l_quantity > 40 THEN 'ZAIF TOMONLAR' || chr(10) || '- weak' END, 'ISHONCH: ' || printf('%.2f', l_linenumber / 10)) AS text FROM lineitem WHERE l_orderkey % 4 = 1),
f AS (SELECT *, min(place) OVER (PARTITION BY request_id, role) AS first FROM p QUALIFY row_number() OVER (PARTITION BY request_id, role ORDER BY round DESC) = 1),
s AS (SELECT request_id, '{D.NO_SYNTHESIS}' || chr(10) || chr(10) || string_agg(text, chr(10) || chr(10) ORDER BY first) AS sides FROM f GROUP BY 1)
SELECT o_orderkey AS request_id, CASE WHEN o_orderkey % 4 = 0 THEN 'verdict' WHEN sides IS NOT NULL THEN 'positions' WHEN o_orderkey % 4 = 2 THEN 'frame' ELSE 'none' END AS level,
  md5(CASE WHEN o_orderkey % 4 = 0 THEN 'XULOSA' || chr(10) || o_orderpriority || CASE WHEN o_orderkey % 8 = 0 THEN chr(10) || chr(10) || 'ASOSLAR' || chr(10) || '- bir' || chr(10) || '- ' || o_custkey ELSE '' END || chr(10) || chr(10) || 'OGOHLANTIRISHLAR' || chr(10) || '- eski'
    WHEN sides IS NOT NULL THEN sides
    WHEN o_orderkey % 4 = 2 THEN CASE WHEN o_orderkey % 8 = 2 THEN 'XULOSA' || chr(10) || o_orderpriority || chr(10) || chr(10) ELSE '' END || 'TEGISHLI NORMALAR' || chr(10) || '- [C1] Kodeks ' || o_custkey || ', 5-modda' || chr(10) || '- [C2] Qonun' || chr(10) || chr(10) || 'YETISHMAYOTGAN MA''LUMOT' || chr(10) || '- sana' ELSE '' END) AS draft
FROM orders LEFT JOIN s ON request_id = o_orderkey""")
def draft_answers(spark, sf_dir):
    key = F.col("o_orderkey")
    none = F.lit(None)
    reasoning = F.when(key % 8 == 0, F.array(F.lit("bir"), F.col("o_custkey").cast("string"))).otherwise(F.array().cast("array<string>"))
    verdict = F.when(key % 4 == 0, F.struct(F.col("o_orderpriority").alias("conclusion"), reasoning.alias("reasoning"), F.array(F.lit("eski")).alias("caveats")))
    norm = lambda tag, title, article: F.struct(F.lit(tag).alias("tag"), title.alias("title"), article.cast("string").alias("article"))
    norms = F.array(norm("C1", F.concat(F.lit("Kodeks "), F.col("o_custkey").cast("string")), F.lit("5")), norm("C2", F.lit("Qonun"), none))
    frame = F.when(key % 4 == 2, F.struct(F.when(key % 8 == 2, F.col("o_orderpriority")).alias("answer"), norms.alias("norms"), F.array(F.lit("sana")).alias("unknowns")))
    lines = table(spark, sf_dir, "lineitem").where("l_orderkey % 4 = 1")
    tags = F.array(F.concat(F.lit("C"), F.col("l_linenumber").cast("string")), F.lit("C9"))
    argument = F.struct(F.lit("kuchli").alias("strength"), F.concat(F.lit("claim "), F.col("l_suppkey").cast("string")).alias("claim"), tags.alias("citations"))
    position = F.struct(
        _role().alias("role"), F.concat(F.lit("stance "), F.col("l_partkey").cast("string")).alias("stance"), F.when(F.col("l_quantity") > 25, F.array(argument)).alias("arguments"),
        F.when(F.col("l_quantity") > 40, F.array(F.lit("weak"))).alias("weaknesses"), (F.col("l_linenumber") / 10).alias("confidence"),
    )
    said = lines.select(F.col("l_orderkey").alias("request_id"), F.expr(POS).alias("place"), F.expr(POS).alias("round"), position.alias("position"))
    drafted = D.draft_answers(table(spark, sf_dir, "orders").select(key.alias("request_id"), verdict.alias("verdict"), frame.alias("frame")), said)
    return drafted.select("request_id", "level", F.md5("draft").alias("draft"))


@query(f"""
WITH r AS (SELECT o_orderkey AS request_id, CASE WHEN o_orderkey % 7 = 0 THEN ['judge', 'jurist'] WHEN o_orderkey % 3 = 0 THEN ['jurist'] WHEN o_orderkey % 3 = 1 THEN ['jurist', 'professor', 'judge'] ELSE ['jurist', 'advocate', 'prosecutor', 'professor', 'judge'] END AS roles FROM orders),
a AS (SELECT l_orderkey AS request_id, list({ROLE}) AS came FROM lineitem GROUP BY 1)
SELECT request_id, array_to_string(list_filter(roles, lambda x: NOT coalesce(list_contains(came, x), false)), ',') AS missing FROM r LEFT JOIN a USING (request_id)""")
def roles_missing(spark, sf_dir):
    key = F.col("o_orderkey")
    mode = F.when(key % 3 == 0, "simple").when(key % 3 == 1, "standard").otherwise("complex")
    requests = table(spark, sf_dir, "orders").select(key.alias("request_id"), mode.alias("mode"), F.when(key % 7 == 0, F.array(F.lit("judge"), F.lit("jurist"))).alias("only_roles"))
    came = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("request_id"), _role().alias("role"))
    return D.missing_roles(D.participation(requests, came)).select("request_id", F.array_join("missing", ",").alias("missing"))


BODY = "CASE l_partkey % 6 WHEN 0 THEN ' qisqa ' WHEN 1 THEN 'Ushbu modda oʻzgartirilmagan matn' WHEN 2 THEN 'Ushbu modda o''zgartirilmagan matn' WHEN 3 THEN 'Ushbu модда кирилл matn bilan yozilgan' WHEN 4 THEN 'Yozing: kimdir@example.org manziliga yuboring' ELSE 'Toza va yetarlicha uzun matn shu yerda' END"


@query(f"""
WITH e AS (SELECT l_orderkey AS doc_id, {POS} AS pos, CASE WHEN l_suppkey % 9 = 0 THEN NULL ELSE CAST(l_suppkey % 4 AS VARCHAR) END AS article, l_suppkey % 8 AS step, {BODY} AS body, CASE WHEN l_partkey % 2 = 0 THEN 'uz' ELSE 'ru' END AS lang,
    strftime(l_shipdate, '%Y-%m-%d') AS valid_from, CASE WHEN l_suppkey % 6 = 0 THEN strftime(l_shipdate, '%Y-%m-%d') END AS valid_to FROM lineitem),
m AS (SELECT *, article IS NOT NULL AND row_number() OVER (PARTITION BY doc_id, article ORDER BY pos) > 1 AS again, article IS NOT NULL AND pos = max(pos) OVER (PARTITION BY doc_id, article) AS stands FROM e),
f AS (SELECT doc_id, pos, unnest([CASE WHEN article IS NULL THEN 'modda_raqami_yoq' END, CASE WHEN again THEN 'modda_takrorlanadi' END, CASE WHEN step = 5 THEN 'ierarxiya_nomuvofiq' END, CASE WHEN valid_from > '2000-01-01' THEN 'sana_kelajakda' END, CASE WHEN valid_from >= valid_to THEN 'sana_mantiqsiz' END,
    CASE WHEN stands AND article = '1' AND doc_id % 3 = 0 THEN 'bekor_qilingan_matnda' END, CASE WHEN body = ' qisqa ' THEN 'matn_qisqa' END, CASE WHEN lang = 'uz' AND contains(body, 'модда') THEN 'kirill_qoldigi' END, CASE WHEN contains(body, '''') THEN 'apostrof_nokanonik' END, CASE WHEN contains(body, '@') THEN 'pii_topildi' END]) AS code FROM m)
SELECT doc_id, pos, code, CASE WHEN code IN ('kirill_qoldigi', 'apostrof_nokanonik') THEN 'warning' ELSE 'error' END AS severity FROM f WHERE code IS NOT NULL""")
def element_checks(spark, sf_dir):
    """All codes over articles written from lines, under the headers of their documents."""
    day = F.date_format("l_shipdate", "yyyy-MM-dd")
    step = F.when(F.col("l_suppkey") % 8 == 5, "Yoʻq boʻlim").otherwise("BIRINCHI BOB")
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), F.expr(POS).alias("pos"), F.lit("article").alias("level"), F.lit("m").alias("title"),
        F.when(F.col("l_suppkey") % 9 != 0, (F.col("l_suppkey") % 4).cast("string")).alias("article"), F.array(step).alias("path"), F.expr(BODY.replace("o''z", "o\\'z")).alias("body"),
        F.when(F.col("l_partkey") % 2 == 0, "uz").otherwise("ru").alias("lang"), day.alias("valid_from"), F.when(F.col("l_suppkey") % 6 == 0, day).alias("valid_to"),
    )
    nothing = F.lit(None).cast("string")
    headers = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.lit(0).cast("bigint").alias("pos"), F.lit("chapter").alias("level"), F.lit("Birinchi bob").alias("title"), nothing.alias("article"), F.array().cast("array<string>").alias("path"), nothing.alias("body"), nothing.alias("lang"), nothing.alias("valid_from"), nothing.alias("valid_to"))
    versions = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.lit("1").alias("article"), F.when(F.col("o_orderkey") % 3 == 0, "repealed").otherwise("in_force").alias("status"))
    found = Q.element_findings(lines.unionByName(headers), versions, "2000-01-01", F.col("body").rlike(r"[\w.]+@[\w.]+\.[a-z]{2,}"))
    return found.select("doc_id", "pos", "code", "severity")


@query(f"""
WITH c AS (SELECT l_orderkey AS answer_id, {POS} AS pos, CASE l_partkey % 4 WHEN 0 THEN 'no_citation' WHEN 1 THEN 'unsupported' WHEN 2 THEN 'wrong_article' END AS reason, CASE l_partkey % 4 WHEN 3 THEN 'kept' WHEN 1 THEN 'flagged' ELSE 'dropped' END AS status, ['C' || (l_suppkey % 3 + 1), 'C' || (l_suppkey % 5 + 1)] AS tags FROM lineitem),
r AS (SELECT answer_id, reason, min(pos) AS p FROM c WHERE reason IS NOT NULL GROUP BY 1, 2), rs AS (SELECT answer_id, string_agg(reason, ',' ORDER BY p) AS reasons FROM r GROUP BY 1),
u AS (SELECT answer_id, tag, min((pos, n)) AS p FROM (SELECT answer_id, pos, unnest(tags) AS tag, unnest([0, 1]) AS n FROM c WHERE status <> 'dropped') WHERE tag <> 'C5' GROUP BY 1, 2), us AS (SELECT answer_id, string_agg(tag, ',' ORDER BY p) AS used FROM u GROUP BY 1)
SELECT DISTINCT answer_id, coalesce(reasons, '') AS reasons, coalesce(used, '') AS used FROM c LEFT JOIN rs USING (answer_id) LEFT JOIN us USING (answer_id)""")
def gate_reasons(spark, sf_dir):
    part = F.col("l_partkey") % 4
    tag = lambda n: F.concat(F.lit("C"), (F.col("l_suppkey") % n + 1).cast("string"))
    reason = F.when(part == 0, "no_citation").when(part == 1, "unsupported").when(part == 2, "wrong_article")
    status = F.when(part == 3, "kept").when(part == 1, "flagged").otherwise("dropped")
    checked = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("answer_id"), F.expr(POS).alias("pos"), reason.alias("reason"), status.alias("status"), F.array(tag(3), tag(5)).alias("tags"))
    known = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("answer_id"), F.explode(F.array(*[F.lit(f"c{i}") for i in range(1, 5)])).alias("tag"))
    return G.gate_reasons(checked, known).select("answer_id", F.array_join("reasons", ",").alias("reasons"), F.array_join("used", ",").alias("used"))


@query("""
WITH e AS (SELECT user_id, event_id, event_id % 3 AS r, CAST(json_extract(props, '$.k') AS VARCHAR) AS k FROM events),
u AS (SELECT user_id, max(event_id) FILTER (WHERE r = 0) AS m0, max(event_id) FILTER (WHERE r = 1) AS m1, max(event_id) FILTER (WHERE r = 2) AS m2, max(event_id) FILTER (WHERE r < 2) AS m, max_by(k, event_id) FILTER (WHERE r < 2) AS k FROM e GROUP BY 1)
SELECT user_id, 'a' AS path, '5' AS value FROM u WHERE m2 > coalesce(m, -1) UNION ALL SELECT user_id, 'a.k', k FROM u WHERE m > coalesce(m2, -1)
UNION ALL SELECT user_id, 'a.in.t', 'x y' FROM u WHERE m0 > coalesce(m2, -1) UNION ALL SELECT user_id, 'b', '[1, {"z": 2}]' FROM u WHERE m0 IS NOT NULL UNION ALL SELECT user_id, 'c', '{}' FROM u WHERE m1 IS NOT NULL""")
def layered_settings(spark, sf_dir):
    """Settings of a user, laid over each other in the order of events."""
    k = F.regexp_extract("props", r"(\d+)", 1)
    text = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('{"a": {"k": '), k, F.lit(', "in": {"t": "x y"}}, "b": [1, {"z": 2}]}'))).when(F.col("event_id") % 3 == 1, F.concat(F.lit('{"a": {"k": '), k, F.lit('}, "c": {}}'))).otherwise(F.lit('{"a": 5}'))
    merged = FO.merged_settings(table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("layer"), text.alias("config")))
    return merged.select(F.col("key").alias("user_id"), "path", F.when(F.col("path") == "b", F.lit('[1, {"z": 2}]')).otherwise(F.col("value")).alias("value"))


@query("SELECT event_id AS request_id, user_id FROM events WHERE event_id % 4 <> 3 AND user_id % 10 <> 1 AND ts + INTERVAL 1 DAY > TIMESTAMP '2024-01-20 00:00:00' AND user_id IN (SELECT c_custkey FROM customer)")
def session_users(spark, sf_dir):
    """Tokens of requests, some of them of nobody, by sessions that last a day."""
    events = table(spark, sf_dir, "events")
    token = F.concat(F.lit("t"), F.col("event_id").cast("string"))
    asked = events.select(F.col("event_id").alias("request_id"), F.when(F.col("event_id") % 4 == 3, "nobody's").otherwise(token).alias("token"))
    sessions = AC.token_digests(events.select(token.alias("token"), "user_id", (F.col("ts") + F.expr("INTERVAL 1 DAY")).alias("expires_at"))).drop("token")
    users = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), (F.col("c_custkey") % 10 == 1).alias("blocked"))
    return AC.session_users(asked, sessions, users, "2024-01-20 00:00:00")


@query("SELECT l_orderkey % 50 AS doc_id, CAST(l_partkey % 30 AS VARCHAR) AS article, string_agg(DISTINCT 'Bob ' || (l_suppkey % 3) || ' > Paragraf ' || (l_linenumber % 2), ';' ORDER BY 'Bob ' || (l_suppkey % 3) || ' > Paragraf ' || (l_linenumber % 2)) AS hierarchies FROM lineitem GROUP BY 1, 2")
def article_hierarchies(spark, sf_dir):
    path = F.array(F.concat(F.lit("Bob "), (F.col("l_suppkey") % 3).cast("string")), F.concat(F.lit("Paragraf "), (F.col("l_linenumber") % 2).cast("string")))
    chunks = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 50).alias("doc_id"), (F.col("l_partkey") % 30).cast("string").alias("article"), path.alias("path"))
    return C.article_hierarchies(chunks).select("doc_id", "article", F.array_join("hierarchies", ";").alias("hierarchies"))


@query("""
WITH e AS (SELECT CAST(l_orderkey AS VARCHAR) AS src, 'p' || l_partkey AS dst, CASE WHEN l_linenumber % 2 = 0 THEN 'link' ELSE 'text' END AS kind FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P'))
SELECT found, kind, count(*) AS n_references, count(DISTINCT (src, dst)) AS n_edges FROM e, (VALUES ('absent'), ('good')) f(found) GROUP BY 1, 2""")
def cached_graph(spark, sf_dir):
    """References of the indexed documents: built when first asked for, read from the cache the second time."""
    path = store.shared_path(spark, "graph")
    indexed = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").cast("string").alias("doc_id"), F.md5(F.col("o_orderpriority")).alias("content_sha256"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("src"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("dst"), F.when(F.col("l_linenumber") % 2 == 0, "link").otherwise("text").alias("kind"), F.lit(True).alias("resolved"))
    build = lambda docs: lines.join(docs.select(F.col("doc_id").alias("src")), "src", "left_semi")
    out = None
    for _ in range(2):
        edges, found = GC.cached_graph(indexed, path, build)
        stats = GR.graph_stats(edges).where("kind IS NOT NULL").select(F.lit(found).alias("found"), "kind", "n_references", "n_edges")
        out = stats if out is None else out.unionByName(stats)
    return out


@query(r"""
WITH t AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN replace(text, 'an', 'аn') WHEN doc_id % 3 = 1 THEN replace(text, 'o ', 'o’ ') ELSE replace(text, '. ', '. https://x.org' || chr(10)) END AS text FROM documents),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM t),
c AS (SELECT doc_id, line, n FROM l WHERE NOT regexp_matches(line, '^\s*(?:import |export \* |from )|https?://') AND regexp_matches(line, '[Ѐ-ӿ]|[oOgG][''‘’`´]')),
w AS (SELECT doc_id, n, unnest(regexp_extract_all(line, '[\p{L}ʻʼ''’]+|[^\p{L}ʻʼ''’]+')) AS word, generate_subscripts(regexp_extract_all(line, '[\p{L}ʻʼ''’]+|[^\p{L}ʻʼ''’]+'), 1) AS i FROM c),
o AS (SELECT doc_id, n, unnest(regexp_extract_all(line, '[oOgG][''‘’`´]|.')) AS word, generate_subscripts(regexp_extract_all(line, '[oOgG][''‘’`´]|.'), 1) AS i FROM c),
wp AS (SELECT doc_id, n, word, 1 + coalesce(sum(length(word)) OVER (PARTITION BY doc_id, n ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS p FROM w),
op AS (SELECT doc_id, n, word, 1 + coalesce(sum(length(word)) OVER (PARTITION BY doc_id, n ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS p FROM o)
SELECT doc_id, CAST(n AS INTEGER) AS line, CAST(p AS INTEGER) AS "column", 'aralash-yozuv' AS rule, word FROM wp WHERE regexp_matches(word, '[A-Za-z]') AND regexp_matches(word, '[Ѐ-ӿ]')
UNION ALL SELECT doc_id, CAST(n AS INTEGER), CAST(p AS INTEGER), 'apostrof-o-g', word FROM op WHERE length(word) = 2""")
def lint_places(spark, sf_dir):
    """Words of mixed script and wrong apostrophes with line and column, over whole documents."""
    docs = table(spark, sf_dir, "documents")
    said = F.when(F.col("doc_id") % 3 == 0, F.replace("text", F.lit("an"), F.lit("аn"))).when(F.col("doc_id") % 3 == 1, F.replace("text", F.lit("o "), F.lit("o’ "))).otherwise(F.replace("text", F.lit(". "), F.lit(". https://x.org\n")))
    return T.lint_places(docs.select("doc_id", said.alias("text")))


@query("""
WITH s AS (SELECT o_orderkey, ['pretrial', 'first_instance', 'appeal', 'cassation', 'supervisory', 'execution'] AS stages, CAST(o_orderkey % 6 + 1 AS INT) AS n FROM orders),
d AS (SELECT l_orderkey, count(*) FILTER (WHERE l_shipdate < o_orderdate + INTERVAL 30 DAY) AS expired FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1)
SELECT s.o_orderkey, stages[n] AS stage, stages[n + 1] AS next_stage, coalesce(expired, 0) AS expired FROM s LEFT JOIN d ON l_orderkey = s.o_orderkey""")
def case_stages(spark, sf_dir):
    """The stage after each case's, and how many of its deadlines have passed by a month after it began."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.element_at(F.array(*[F.lit(x) for x in CT.STAGES]), (F.col("o_orderkey") % 6 + 1).cast("int")).alias("stage"), F.date_add("o_orderdate", 30).alias("today"))
    due = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(F.struct(F.col("l_linenumber").alias("action"), F.to_date("l_shipdate").alias("due"))).alias("deadlines"))
    joined = orders.join(due, "o_orderkey", "left")
    expired = F.coalesce(F.size(CT.expired_deadlines(F.coalesce("deadlines", F.array().cast("array<struct<action:int,due:date>>")), F.col("today"))), F.lit(0))
    return joined.select("o_orderkey", "stage", CT.next_stage(F.col("stage")).alias("next_stage"), expired.cast("bigint").alias("expired"))


@query(f"""
WITH f AS (SELECT l_orderkey AS case_id, {POS} AS pos, 'R' || (l_suppkey % 6) AS code, ['critical', 'major', 'minor', 'info'][CAST(l_partkey % 4 + 1 AS INT)] AS severity, l_partkey % 4 AS place FROM lineitem),
r AS (SELECT case_id, 'advice ' || (CAST(substr(code, 2) AS INT) % 4) AS recommendation, min((place, pos, code)) AS first FROM f WHERE severity <> 'info' GROUP BY 1, 2)
SELECT case_id, string_agg(recommendation, ';' ORDER BY first) AS corrections FROM r GROUP BY 1""")
def court_corrections(spark, sf_dir):
    found = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("case_id"), F.expr(POS).alias("pos"), F.concat(F.lit("R"), (F.col("l_suppkey") % 6).cast("string")).alias("code"), F.element_at(F.array(*[F.lit(x) for x in CT.SEVERITIES]), (F.col("l_partkey") % 4 + 1).cast("int")).alias("severity"))
    codes = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 6).alias("n")).distinct().select(F.concat(F.lit("R"), F.col("n").cast("string")).alias("code"), F.concat(F.lit("advice "), (F.col("n") % 4).cast("string")).alias("recommendation"))
    return CT.corrections(found, codes).select("case_id", F.array_join("corrections", ";").alias("corrections"))


@query(f"""
WITH t AS (SELECT l_orderkey AS answer_id, {POS} AS step, l_partkey % 5 AS kept, l_suppkey % 3 AS dropped FROM lineitem WHERE l_quantity > 20),
g AS (SELECT answer_id, max_by({{k: kept, d: dropped}}, step) AS g FROM t GROUP BY 1)
SELECT o_orderkey AS answer_id, coalesce(g.k, 0) AS gate_kept, coalesce(g.d, 0) AS gate_dropped FROM orders LEFT JOIN g ON answer_id = o_orderkey""")
def gate_counts(spark, sf_dir):
    trace = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("answer_id"), F.expr(POS).alias("step"), F.when(F.col("l_quantity") > 20, "gate").otherwise("agent").alias("node"), (F.col("l_partkey") % 5).alias("kept"), (F.col("l_suppkey") % 3).alias("dropped"))
    return M.gate_counts(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("answer_id")), trace)


@query("SELECT event_id, total FROM (SELECT event_id, ts, count(*) OVER () AS total FROM events WHERE user_id = 7 OR json_extract(props, '$.k') = 42) ORDER BY ts DESC, event_id DESC LIMIT 20 OFFSET 5")
def own_history(spark, sf_dir):
    """A page of one person's events, under their user id or their session."""
    events = table(spark, sf_dir, "events").withColumn("session_id", F.get_json_object("props", "$.k").cast("int"))
    return M.own_history(events, F.lit(7), F.lit(42), 5, 20, [F.col("ts").desc(), F.col("event_id").desc()]).select("event_id", "total")
