"""Queries of joins, integrity, validity, usage, events, panels and risk over the tables of records."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillmesh.operators import graph as G
from quillmesh.operators import metrics as M
from quillmesh.operators import retrieval as R
from quillmesh.plans.base import Registry, table

REGISTRY = Registry()
query = REGISTRY.query
DAY = "CAST(strftime({}, '%Y-%m-%d') AS VARCHAR)"
NOW = "2024-01-25 00:00:00"


def _iso(column):
    return F.date_format(column, "yyyy-MM-dd")


@query(f"SELECT o_orderkey, status, valid_from, valid_to FROM (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'repealed' ELSE 'in_force' END AS status, {DAY.format('o_orderdate')} AS valid_from, CASE WHEN o_orderkey % 3 = 0 THEN {DAY.format('o_orderdate + INTERVAL 400 DAY')} END AS valid_to FROM orders) WHERE (status <> 'repealed' OR valid_to IS NOT NULL) AND valid_from <= '1998-01-01' AND (valid_to IS NULL OR valid_to > '1998-01-01')")
def as_of_filter(spark, sf_dir):
    versions = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "repealed").otherwise("in_force").alias("status"), _iso("o_orderdate").alias("valid_from"), F.when(F.col("o_orderkey") % 3 == 0, _iso(F.date_add("o_orderdate", 400))).alias("valid_to"))
    return R.as_of_filter(versions, F.lit("1998-01-01"), explicit=True)


@query("SELECT o_orderpriority, CAST(count(CASE WHEN o_orderkey % 4 <> 0 THEN 1 END) AS BIGINT) AS confirmed, CAST(count(CASE WHEN o_orderkey % 4 = 0 THEN 1 END) AS BIGINT) AS unknown FROM orders GROUP BY 1")
def date_coverage(spark, sf_dir):
    dated = F.nullif(F.when(F.col("o_orderkey") % 4 == 0, "").otherwise(_iso("o_orderdate")), F.lit(""))
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count(dated).alias("confirmed"), (F.count("*") - F.count(dated)).alias("unknown"))


@query(f"""
WITH n AS (SELECT o_custkey AS doc, o_orderkey % 10 AS article, {DAY.format('o_orderdate')} AS d, o_orderstatus AS s FROM orders)
SELECT doc, article, max(CASE WHEN s <> 'F' AND d <= '1999-01-01' THEN d END) AS valid_from, min(CASE WHEN s = 'F' THEN d END) AS valid_to, min(CASE WHEN s <> 'F' AND d > '1999-01-01' THEN d END) AS pending_from, CASE WHEN bool_or(s = 'F') THEN 'repealed' ELSE 'in_force' END AS status, count(*) AS note_count FROM n GROUP BY 1, 2""")
def article_versions(spark, sf_dir):
    notes = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), (F.col("o_orderkey") % 10).alias("article"), _iso("o_orderdate").alias("d"), F.col("o_orderstatus").alias("s"))
    from quillmesh.operators.versions import build_versions

    signals = notes.select("doc", "article", F.when(F.col("s") == "F", "repealed").otherwise("edition").alias("kind"), F.col("d").alias("effective_date"))
    return build_versions(signals, "1999-01-01", ["doc", "article"])


@query(f"SELECT c_mktsegment AS segment, CAST(o_orderstatus AS VARCHAR) AS status, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ROLLUP (c_mktsegment, o_orderstatus)")
def version_rollup(spark, sf_dir):
    joined = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    return joined.rollup("c_mktsegment", "o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")).select(F.col("c_mktsegment").alias("segment"), F.col("o_orderstatus").alias("status"), "n", "total")


@query("SELECT p_partkey, lo, hi FROM part JOIN (SELECT DISTINCT p_size * 10 AS lo, p_size * 10 + p_size % 7 AS hi FROM part) ON p_partkey BETWEEN lo AND hi")
def range_label_join(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    ranges = part.select((F.col("p_size") * 10).alias("lo"), (F.col("p_size") * 10 + F.col("p_size") % 7).alias("hi")).distinct()
    return G.range_lookup(part.select("p_partkey"), ranges, "p_partkey", "lo", "hi", 16).select("p_partkey", "lo", "hi")


@query("""
WITH names AS (SELECT DISTINCT string_split(p_name, ' ')[1] AS name FROM part UNION SELECT DISTINCT p_name FROM part), registry AS (SELECT p_name AS title, min(p_partkey) AS key FROM part GROUP BY 1),
e AS (SELECT name, key FROM names JOIN registry ON name = title), r AS (SELECT name FROM names WHERE name NOT IN (SELECT name FROM e)),
n AS (SELECT name, count(DISTINCT key) AS k, min(key) AS key FROM r JOIN registry ON contains(title, name) OR contains(name, title) GROUP BY 1)
SELECT name, key FROM e UNION ALL SELECT name, key FROM n WHERE k = 1""")
def containment_join(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    names = part.select(F.split_part("p_name", F.lit(" "), F.lit(1)).alias("name")).union(part.select("p_name")).distinct()
    registry = part.groupBy(F.col("p_name").alias("title")).agg(F.min("p_partkey").alias("key"))
    return G.contains_lookup(names, registry)


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def semi_exists(spark, sf_dir):
    rich = table(spark, sf_dir, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(rich, "c_custkey", "left_semi").select("c_custkey")


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def anti_missing(spark, sf_dir):
    return table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti").select("o_orderkey")


REFERENCES = """
WITH r AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE l_partkey + CASE WHEN l_partkey % 13 = 0 THEN 100000000 ELSE 0 END END AS target FROM lineitem),
t AS (SELECT p_partkey AS target, CASE WHEN p_size > 45 THEN 'repealed' ELSE 'in_force' END AS status FROM part),
c AS (SELECT CASE WHEN r.target IS NULL THEN 'unresolved' WHEN status IS NULL THEN 'broken' WHEN status = 'repealed' THEN 'repealed' ELSE 'healthy' END AS issue FROM r LEFT JOIN t USING (target))
"""


def _references(spark, sf_dir):
    target = F.when(F.col("l_partkey") % 11 != 0, F.col("l_partkey") + F.when(F.col("l_partkey") % 13 == 0, 100000000).otherwise(0))
    references = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", target.alias("target"))
    targets = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("target"), F.when(F.col("p_size") > 45, "repealed").otherwise("in_force").alias("status"))
    return G.classify_references(references, targets)


@query(REFERENCES + "SELECT k.issue AS issue, CAST(count(c.issue) AS BIGINT) AS n FROM (VALUES ('unresolved'), ('broken'), ('repealed'), ('healthy'), ('circular')) k(issue) LEFT JOIN c USING (issue) GROUP BY 1")
def citation_integrity(spark, sf_dir):
    counts = _references(spark, sf_dir).groupBy("issue").agg(F.count("*").alias("n"))
    return G.with_zero_classes(counts, "issue", ["unresolved", "broken", "repealed", "healthy", "circular"])


@query(REFERENCES + "SELECT count(*) AS total, count(CASE WHEN issue <> 'unresolved' THEN 1 END) AS resolvable, round(avg(CASE WHEN issue IN ('broken', 'repealed') THEN 1.0 ELSE 0 END), 6) AS bad_share FROM c")
def reference_report(spark, sf_dir):
    return _references(spark, sf_dir).agg(F.count("*").alias("total"), F.count_if(F.col("issue") != "unresolved").alias("resolvable"), F.round(F.avg(F.when(F.col("issue").isin("broken", "repealed"), 1.0).otherwise(0.0)), 6).alias("bad_share"))


@query("""
WITH e AS (SELECT DISTINCT o_custkey AS src, 1000000 + l_suppkey AS dst FROM orders JOIN lineitem ON o_orderkey = l_orderkey), b AS (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e),
s AS (SELECT c_custkey AS start FROM customer WHERE c_custkey % 20 = 0), h1 AS (SELECT DISTINCT start, b AS node FROM s JOIN b ON start = a), h2 AS (SELECT DISTINCT start, b.b AS node FROM h1 JOIN b ON node = a)
SELECT start, node, 1 AS hops FROM h1 UNION ALL SELECT start, node, 2 FROM h2 WHERE node <> start AND NOT EXISTS (SELECT 1 FROM h1 WHERE h1.start = h2.start AND h1.node = h2.node)""")
def graph_neighbors_k2(spark, sf_dir):
    edges = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("src"), (F.col("l_suppkey") + 1000000).alias("dst")).distinct()
    return G.neighbours(edges, table(spark, sf_dir, "customer").where("c_custkey % 20 = 0").select(F.col("c_custkey").alias("start")), 2, "both")


@query("""
WITH e AS (SELECT l_returnflag AS kind, l_orderkey AS src, 10000000 + l_partkey AS dst FROM lineitem), b AS (SELECT kind, src AS node FROM e UNION ALL SELECT kind, dst FROM e)
SELECT kind, count(*) AS n_references, (SELECT count(DISTINCT node) FROM b WHERE b.kind = e.kind) AS n_nodes, count(DISTINCT (src, dst)) AS n_edges FROM e GROUP BY 1
UNION ALL SELECT NULL, count(*), (SELECT count(DISTINCT node) FROM b), count(DISTINCT (src, dst)) FROM e""")
def graph_stats(spark, sf_dir):
    return G.graph_stats(table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("kind"), F.col("l_orderkey").alias("src"), (F.col("l_partkey") + 10000000).alias("dst")))


@query("SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.h IS NULL THEN 'new' WHEN b.h IS NULL THEN 'removed' WHEN a.h = b.h THEN 'unchanged' ELSE 'changed' END AS state FROM (SELECT doc_id, md5(text) AS h FROM documents WHERE doc_id % 7 <> 0) a FULL JOIN (SELECT doc_id, md5(CASE WHEN doc_id % 5 = 0 THEN text || '.' ELSE text END) AS h FROM documents WHERE doc_id % 11 <> 0) b USING (doc_id)")
def change_detection(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    old = docs.where("doc_id % 7 <> 0").select("doc_id", F.md5("text").alias("h"))
    new = docs.where("doc_id % 11 <> 0").select("doc_id", F.md5(F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("."))).otherwise(F.col("text"))).alias("h"))
    return G.change_states(old, new, "doc_id", "h")


@query(f"SELECT count(*) AS n_events, round(sum(value), 4) AS total_value, round(avg(value), 6) AS mean_value, count(CASE WHEN event_type = 'error' THEN 1 END) AS n_errors FROM events WHERE ts >= TIMESTAMP '{NOW}' - INTERVAL 48 HOUR AND ts <= TIMESTAMP '{NOW}'")
def event_summary(spark, sf_dir):
    return M.event_summary(table(spark, sf_dir, "events"), NOW, 48, error=F.col("event_type") == "error")


@query("SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY GROUPING SETS ((event_type), (strftime(ts, '%Y-%m-%d')))")
def event_kinds(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_type", _iso("ts").alias("day"))
    return events.groupingSets([["event_type"], ["day"]], "event_type", "day").agg(F.count("*").alias("n"))


@query("SELECT user_id, n, last_type FROM (SELECT user_id, count(*) AS n, arg_max(event_type, (ts, event_id)) AS last_type FROM events GROUP BY 1) ORDER BY n DESC, user_id LIMIT 10")
def top_users(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.max_by("event_type", F.struct("ts", "event_id")).alias("last_type")).orderBy(F.desc("n"), "user_id").limit(10)


@query("SELECT day, count(*) AS new_actors FROM (SELECT user_id, strftime(min(ts), '%Y-%m-%d') AS day FROM events GROUP BY 1) GROUP BY 1")
def new_actors(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(_iso(F.min("ts")).alias("day")).groupBy("day").agg(F.count("*").alias("new_actors"))


@query("SELECT count(*) AS events, count(DISTINCT user_id) AS actors, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_at, count(CASE WHEN event_type = 'purchase' THEN 1 END) AS purchases FROM events")
def lifetime(spark, sf_dir):
    return table(spark, sf_dir, "events").agg(F.count("*").alias("events"), F.countDistinct("user_id").alias("actors"), F.date_format(F.min("ts"), "yyyy-MM-dd HH:mm:ss").alias("first_at"), F.count_if(F.col("event_type") == "purchase").alias("purchases"))


@query("SELECT event_id, user_id FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id LIMIT 5")
def latest_errors(spark, sf_dir):
    return table(spark, sf_dir, "events").where("event_type = 'error'").orderBy(F.desc("ts"), "event_id").limit(5).select("event_id", "user_id")


@query("SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, event_type AS endpoint, count(*) AS n FROM events GROUP BY 1, 2, 3")
def usage_daily(spark, sf_dir):
    return M.usage(table(spark, sf_dir, "events"), "user_id", _iso("ts"), "event_type")


@query("""
WITH u AS (SELECT user_id, count(*) AS month_n, count(CASE WHEN strftime(ts, '%Y-%m-%d') = '2024-01-15' THEN 1 END) AS day_n FROM events WHERE strftime(ts, '%Y-%m') = '2024-01' GROUP BY 1)
SELECT user_id, day_n AS used_today, month_n AS used_month, greatest(0, 70 - month_n) AS remaining, CASE WHEN user_id % 9 = 0 THEN 'feature' WHEN day_n >= 4 THEN 'daily' WHEN month_n >= 70 THEN 'monthly' ELSE 'allow' END AS decision FROM u""")
def quota_decision(spark, sf_dir):
    events = table(spark, sf_dir, "events").where(F.date_format("ts", "yyyy-MM") == "2024-01")
    used = events.groupBy("user_id").agg(F.count_if(_iso("ts") == "2024-01-15").alias("used_today"), F.count("*").alias("used_month"))
    decision = M.access(F.col("user_id") % 9 != 0, F.lit(4), F.lit(70), F.col("used_today"), F.col("used_month"))
    return used.select("user_id", "used_today", "used_month", F.greatest(F.lit(0), 70 - F.col("used_month")).alias("remaining"), decision.alias("decision"))


@query("SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_seen, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_seen, count(*) AS requests FROM events GROUP BY 1")
def actor_upsert(spark, sf_dir):
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return M.actor_table(table(spark, sf_dir, "events")).select("user_id", text("first_seen"), text("last_seen"), "requests")


@query("SELECT list_sort(list(value))[CAST(floor(count(*) / 2) AS BIGINT) + 1] AS median, list_sort(list(value))[least(CAST(floor(count(*) * 0.95) AS BIGINT), count(*) - 1) + 1] AS p95, count(*) AS n FROM events WHERE value IS NOT NULL")
def latency_nearest_rank(spark, sf_dir):
    return M.nearest_ranks(table(spark, sf_dir, "events"), "value")


@query("""
WITH v AS (SELECT doc_id % 200 AS sample, CASE WHEN toxic = 1 THEN 'reject' WHEN quality = 1 THEN 'accept' ELSE 'revise' END AS verdict, 0.7 + (doc_id % 4) * 0.1 AS confidence FROM labels),
g AS (SELECT sample, count(*) AS n, count(CASE WHEN verdict = 'accept' THEN 1 END) AS a, count(CASE WHEN verdict = 'reject' THEN 1 END) AS r, min(confidence) AS c FROM v GROUP BY 1)
SELECT sample, n, CASE WHEN 2 * r >= n THEN 'rejected' WHEN a = n AND c >= 0.75 THEN 'accepted' ELSE 'unclear' END AS decision, round(greatest(a, r, n - a - r) / n, 6) AS agreement FROM g""")
def panel_decision(spark, sf_dir):
    verdict = F.when(F.col("toxic") == 1, "reject").when(F.col("quality") == 1, "accept").otherwise("revise")
    return M.panel_decision(table(spark, sf_dir, "labels").select((F.col("doc_id") % 200).alias("sample"), verdict.alias("verdict"), (0.7 + (F.col("doc_id") % 4) * 0.1).alias("confidence")))


@query("SELECT count(*) AS n, count(CASE WHEN quality = 1 THEN 1 END) AS good, count(CASE WHEN toxic = 1 THEN 1 END) AS toxic, round(avg(quality), 6) AS share FROM labels")
def label_stats(spark, sf_dir):
    return table(spark, sf_dir, "labels").agg(F.count("*").alias("n"), F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("toxic") == 1).alias("toxic"), F.round(F.avg("quality"), 6).alias("share"))


RULES = [("PROC-001", "l_shipdate < TIMESTAMP '1996-01-01'", 3, 0.25), ("EVID-002", "l_discount >= 0.09", 2, 0.2), ("LAW-003", "l_quantity > 45", 2, 0.15), ("TIME-004", "l_tax >= 0.07 AND l_returnflag = 'R'", 1, 0.1)]
FINDINGS = " UNION ALL ".join(f"SELECT l_orderkey, l_linenumber, '{code}' AS code, {severity} AS severity, {weight} AS weight FROM lineitem WHERE {rule}" for code, rule, severity, weight in RULES)


def _findings(spark, sf_dir):
    rules = F.array(*[F.when(F.expr(rule), F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.lit(weight).alias("weight"))) for code, rule, severity, weight in RULES])
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.explode(F.filter(rules, lambda r: r.isNotNull())).alias("f")).select("l_orderkey", "l_linenumber", "f.*")


@query(f"SELECT l_orderkey, l_linenumber, code, severity FROM ({FINDINGS})")
def rule_findings(spark, sf_dir):
    return _findings(spark, sf_dir).drop("weight")


@query(f"SELECT l_orderkey, round(least(1.0, sum(weight)), 2) AS score, CASE WHEN round(sum(weight), 6) >= 0.7 THEN 'high' WHEN round(sum(weight), 6) >= 0.4 THEN 'medium' WHEN round(sum(weight), 6) >= 0.15 THEN 'low' ELSE 'none' END AS label, count(CASE WHEN severity = 3 THEN 1 END) AS n_high, max(severity) AS worst FROM (SELECT l_orderkey, severity, CAST(weight AS DOUBLE) AS weight FROM ({FINDINGS})) GROUP BY 1")
def risk_labels(spark, sf_dir):
    total = F.round(F.sum("weight"), 6)
    return _findings(spark, sf_dir).groupBy("l_orderkey").agg(F.round(F.least(F.lit(1.0), total), 2).alias("score"), M.risk_label(total).alias("label"), F.count_if(F.col("severity") == 3).alias("n_high"), F.max("severity").alias("worst"))


@query(f"WITH c AS (SELECT l_orderkey, round(least(1.0, sum(CAST(weight AS DOUBLE))), 2) AS score FROM ({FINDINGS}) GROUP BY 1) SELECT o_custkey, count(*) AS n_cases, round(least(1.0, pow(avg(pow(score, 1.5)), 1 / 1.5)), 6) AS risk FROM c JOIN orders ON l_orderkey = o_orderkey GROUP BY 1")
def risk_power_mean(spark, sf_dir):
    cases = _findings(spark, sf_dir).groupBy("l_orderkey").agg(F.round(F.least(F.lit(1.0), F.sum("weight")), 2).alias("score"))
    owners = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    return cases.join(owners, "l_orderkey").groupBy("o_custkey").agg(F.count("*").alias("n_cases"), F.round(M.power_mean(F.col("score")), 6).alias("risk"))


@query("SELECT conv_id, turn, role, total FROM (SELECT *, count(*) OVER () AS total FROM conversations WHERE contains(lower(text), 'tion')) ORDER BY conv_id DESC, turn LIMIT 20 OFFSET 20")
def conversation_listing_page(spark, sf_dir):
    found = table(spark, sf_dir, "conversations").where(F.lower("text").contains("tion"))
    return M.page_of(found, [F.desc("conv_id"), "turn"], 20, 20).select("conv_id", "turn", "role", "total")


@query("SELECT DISTINCT user_id FROM (SELECT user_id FROM events WHERE event_type = 'signup' UNION SELECT c_custkey FROM customer WHERE c_nationkey = 3) WHERE user_id <> 0 AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND value > 50)")
def recipient_set(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    known = events.where("event_type = 'signup'").select("user_id").union(table(spark, sf_dir, "customer").where("c_nationkey = 3").select("c_custkey")).distinct().where("user_id <> 0")
    return known.join(events.where("event_type = 'error' AND value > 50").select("user_id"), "user_id", "left_anti")


@query("SELECT o_orderkey % 100 AS id, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 1 ORDER BY n DESC, id")
def dup_ids(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy((F.col("o_orderkey") % 100).alias("id")).agg(F.count("*").alias("n")).where("n > 1").orderBy(F.desc("n"), "id")


@query("SELECT l_orderkey, l_linenumber, CAST(row_number() OVER (PARTITION BY l_orderkey, l_partkey % 3 ORDER BY l_linenumber, l_partkey, l_suppkey) AS BIGINT) AS occurrence FROM lineitem")
def occurrence_numbers(spark, sf_dir):
    order = Window.partitionBy("l_orderkey", F.col("l_partkey") % 3).orderBy("l_linenumber", "l_partkey", "l_suppkey")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.row_number().over(order).cast("bigint").alias("occurrence"))


@query("SELECT p_brand, count(*) AS n, count(CASE WHEN p_size > 40 THEN 1 END) AS n_large, count(CASE WHEN p_size BETWEEN 20 AND 40 THEN 1 END) AS n_middle, count(CASE WHEN p_size < 20 THEN 1 END) AS n_small FROM part GROUP BY 1")
def severity_pivot(spark, sf_dir):
    sized = table(spark, sf_dir, "part").select("p_brand", F.when(F.col("p_size") > 40, "large").when(F.col("p_size") >= 20, "middle").otherwise("small").alias("size"))
    counts = M.severity_counts(sized, "p_brand", "size", ["large", "middle", "small"])
    return counts.select("p_brand", (F.col("n_large") + F.col("n_middle") + F.col("n_small")).alias("n"), "n_large", "n_middle", "n_small")


@query("SELECT event_id, value, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 4) AS running, coalesce(CAST(datediff('day', lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id), ts) AS BIGINT), -1) AS days_since FROM events")
def trace_durations(spark, sf_dir):
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    running = F.sum("value").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return table(spark, sf_dir, "events").select("event_id", "value", F.round(running, 4).alias("running"), F.coalesce(F.datediff("ts", F.lag("ts").over(order)).cast("bigint"), F.lit(-1)).alias("days_since"))
