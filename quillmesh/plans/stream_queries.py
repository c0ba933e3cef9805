"""Queries of operators with state, and of sources and sinks, over events, conversations, pages and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmesh.plans.base import Registry, table
from quillmesh.sources import archive as A
from quillmesh.streaming import state as S

REGISTRY = Registry()
query = REGISTRY.query


@query()
def rate_limit_sim(spark, sf_dir):
    hourly = table(spark, sf_dir, "events").withColumn("ts", F.timestamp_seconds(F.unix_timestamp("ts") / 600))
    return S.limit_rate(hourly, 2)


@query()
def audit_chain(spark, sf_dir):
    return S.hash_chain(table(spark, sf_dir, "events"), "user_id", "event_id", ["event_id", "event_type", "props"])


@query("SELECT CAST(user_id AS VARCHAR) AS chain, count(*) AS records, CAST(-1 AS BIGINT) AS first_break FROM events GROUP BY 1")
def audit_verified(spark, sf_dir):
    log = S.hash_chain(table(spark, sf_dir, "events"), "user_id", "event_id", ["event_id", "event_type", "props"])
    return S.verify_chain(log).withColumn("first_break", F.coalesce("first_break", F.lit(-1)))


@query("""
WITH e AS (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events), s AS (SELECT *, sum(CASE WHEN p IS NULL OR ts >= p + INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM e)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS started, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, k""")
def session_totals(spark, sf_dir):
    return S.session_totals(table(spark, sf_dir, "events"))


@query("SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS started, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def windowed_counts(spark, sf_dir):
    counted = S.windowed_counts(table(spark, sf_dir, "events"))
    return counted.select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("started"), "event_type", "n", F.round("total", 4).alias("total"))


@query("SELECT event_id FROM events WHERE ts + INTERVAL 86400 SECOND > TIMESTAMP '2024-01-20 00:00:00'")
def unexpired(spark, sf_dir):
    return S.expire(table(spark, sf_dir, "events"), "ts", 86400, "2024-01-20 00:00:00").select("event_id")


@query("SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_seen, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_seen, count(*) AS requests FROM events GROUP BY 1")
def actors_merged(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    side = lambda df: df.groupBy("user_id").agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count("*").alias("requests"))
    merged = S.merge_actors(side(events.where("ts < TIMESTAMP '2024-01-12'")), side(events.where("ts >= TIMESTAMP '2024-01-12'")))
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return merged.select("user_id", text("first_seen"), text("last_seen"), "requests")


@query()
def polished_turns(spark, sf_dir):
    done = S.polish_stream(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), "conv_id", "turn", "text")
    return done.select("conv_id", "turn", F.length("text").alias("size"))


@query("SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS transcript, count(*) AS n FROM conversations GROUP BY 1")
def stream_taps(spark, sf_dir):
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n")
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(text.alias("transcript"), F.count("*").alias("n"))


@query("""
WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<a\\s[^>]*href="([^"]*)"[^>]*>(.*?)</a>', 1)) AS target, unnest(regexp_extract_all(html, '(?is)<a\\s[^>]*href="([^"]*)"[^>]*>(.*?)</a>', 2)) AS title, unnest(range(len(regexp_extract_all(html, '(?is)<a\\s[^>]*href="([^"]*)"[^>]*>(.*?)</a>', 1)))) AS pos FROM pages),
t AS (SELECT page_id, pos, target, trim(regexp_replace(title, '<[^>]*>', '', 'g')) AS title FROM l)
SELECT page_id, pos, target, title FROM (SELECT *, row_number() OVER (PARTITION BY page_id, target ORDER BY pos) AS n FROM t WHERE length(title) >= 6) WHERE n = 1""")
def result_links(spark, sf_dir):
    return A.result_links(table(spark, sf_dir, "pages")).withColumn("pos", F.col("pos").cast("bigint"))


@query("SELECT lang, status, word, lang || '-' || status || '-' || word AS key FROM (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL) l, (SELECT DISTINCT o_orderstatus AS status FROM orders) s JOIN (SELECT DISTINCT lang AS vl, source AS word FROM documents) v ON vl = lang")
def discovery_plan(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    statuses = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("status")).distinct()
    words = docs.select("lang", F.col("source").alias("word")).distinct()
    return A.query_plan([docs.select("lang").distinct(), statuses], words).select("lang", "status", "word", F.concat_ws("-", "lang", "status", "word").alias("key"))


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'new' WHEN doc_id % 3 = 0 THEN 'changed' ELSE 'unchanged' END AS state FROM documents")
def fetch_states(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    known = docs.where("doc_id % 4 <> 0").select("doc_id", F.when(F.col("doc_id") % 3 == 0, "old").otherwise(F.sha2("text", 256)).alias("content_sha256"))
    return A.fetch_states(docs.select("doc_id", F.sha2("text", 256).alias("content_sha256")), known).select("doc_id", "state")


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'Law ' || c_custkey ELSE c_name END AS document, CASE WHEN c_custkey % 3 = 0 THEN 'x.org' END AS url, CASE WHEN c_custkey % 3 = 0 THEN '2024-05-01' END AS version FROM customer")
def file_names(spark, sf_dir):
    name = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("Law "), F.col("c_custkey").cast("string"), F.lit("__x.org__2024-05-01"))).otherwise(F.col("c_name"))
    return table(spark, sf_dir, "customer").select("c_custkey", *A.file_name_parts(name))


@query("SELECT o_custkey, o_orderkey, replaced FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS n, count(*) OVER (PARTITION BY o_custkey) - 1 AS replaced FROM orders) WHERE n = 1")
def last_rows(spark, sf_dir):
    return A.last_rows(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey")


@query("SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 THEN 'fresh' ELSE p_name END AS name FROM part UNION ALL SELECT p_partkey + 10000000, 'fresh' FROM part WHERE p_partkey % 500 = 0")
def store_upsert(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    fresh = part.where("p_partkey % 10 = 0").select("p_partkey", F.lit("fresh").alias("name")).union(part.where("p_partkey % 500 = 0").select(F.col("p_partkey") + 10000000, F.lit("fresh")))
    return A.upsert(part.select("p_partkey", F.col("p_name").alias("name")), fresh, "p_partkey")


@query("SELECT part, count(*) AS n FROM (SELECT CASE WHEN row_number() OVER (ORDER BY doc_id) <= greatest(1, floor(0.05 * count(*) OVER ())) THEN 'validation' ELSE 'train' END AS part FROM labels) GROUP BY 1")
def training_split(spark, sf_dir):
    return A.split_training(table(spark, sf_dir, "labels"), ["doc_id"]).groupBy("part").agg(F.count("*").alias("n"))


@query("SELECT page_id, greatest(20.0, coalesce(CASE WHEN page_id % 2 = 0 THEN page_id % 60 END, 20.0)) AS delay, CAST(CASE WHEN page_id % 3 = 0 THEN page_id ELSE -1 END AS INT) AS hits FROM pages")
def crawl_rules(spark, sf_dir):
    robots = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("User-agent: *\nCrawl-delay: "), (F.col("page_id") % 60).cast("string"))).otherwise("User-agent: *")
    shown = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("<b>Topildi: "), F.col("page_id").cast("string"), F.lit("</b>"))).otherwise("none")
    return table(spark, sf_dir, "pages").select("page_id", A.crawl_delay(robots).alias("delay"), F.coalesce(A.total_hits(shown), F.lit(-1)).alias("hits"))


@query("SELECT doc_id, to_json({doc_id: doc_id, lang: lang}) AS value FROM documents WHERE lang <> ''")
def json_lines(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.to_json(F.struct("doc_id", "lang"), {"ignoreNullFields": "true"}).alias("value"))
