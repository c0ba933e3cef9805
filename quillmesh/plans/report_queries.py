"""Queries of reports and small decisions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillmesh.operators import reports as R
from quillmesh.plans.base import Registry, table

REGISTRY = Registry()
query = REGISTRY.query

ITEMS = "SELECT 'm' || (p_partkey % 4) AS model, p_type AS category, p_size % 3 > p_partkey % 4 - 1 AS passed, 1 + length(p_type) % 3 AS weight, p_size AS tokens, p_retailprice / 100 AS latency FROM part"


def _items(spark, sf_dir):
    return table(spark, sf_dir, "part").selectExpr("concat('m', p_partkey % 4) AS model", "p_type AS category", "p_size % 3 > p_partkey % 4 - 1 AS passed", "1 + length(p_type) % 3 AS weight", "p_size AS tokens", "p_retailprice / 100 AS latency")


@query(f"WITH c AS (SELECT model, category, weight, avg(CASE WHEN passed THEN 1.0 ELSE 0 END) AS m, sum(tokens) AS t, sum(latency) AS l FROM ({ITEMS}) GROUP BY 1, 2, 3) SELECT model, round(CAST(5 * sum(m * weight) / sum(weight) AS DOUBLE), 4) AS score, round(CAST(sum(t) / sum(l) AS DOUBLE), 4) AS tokens_per_second FROM c GROUP BY 1")
def model_benchmark(spark, sf_dir):
    return R.model_scores(_items(spark, sf_dir))


@query(f"WITH c AS (SELECT model, category, weight, avg(CASE WHEN passed THEN 1.0 ELSE 0 END) AS m FROM ({ITEMS}) GROUP BY 1, 2, 3), s AS (SELECT model, round(CAST(5 * sum(m * weight) / sum(weight) AS DOUBLE), 4) AS score FROM c GROUP BY 1) SELECT model FROM s WHERE (SELECT max(score) FROM s) - score < 0.3 ORDER BY length(model), model LIMIT 1")
def model_choice(spark, sf_dir):
    return R.choose_model(R.model_scores(_items(spark, sf_dir)).withColumn("memory", F.length("model")))


KEYWORDS = [("labour", "tion"), ("labour", "ment"), ("civil", "the"), ("tax", "ung"), ("family", "que"), ("criminal", "ing")]


@query("""
WITH k(reviewer, keyword) AS (VALUES """ + ", ".join(f"('{r}', '{w}')" for r, w in KEYWORDS) + """),
s AS (SELECT item_id AS sample, reviewer, CAST(sum((length(text) - length(replace(text, keyword, ''))) / length(keyword)) AS BIGINT) AS score FROM benchmark, k GROUP BY 1, 2),
p AS (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY score DESC, reviewer) AS up, row_number() OVER (PARTITION BY sample ORDER BY score, reviewer DESC) AS down FROM s)
SELECT sample, reviewer, score, CASE WHEN down = 1 THEN 'outsider' ELSE 'expert' END AS place FROM p WHERE (up <= 2 AND score > 0) OR down = 1""")
def reviewer_selection(spark, sf_dir):
    keywords = spark.createDataFrame(KEYWORDS, "reviewer string, keyword string")
    return R.reviewers(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("sample"), "text"), keywords)


@query("SELECT o_orderkey, round(CASE WHEN o_custkey % 10 = 0 THEN 0 WHEN o_orderkey % 2 = 0 THEN CASE WHEN o_custkey % 3 = 0 THEN 1 ELSE 0 END ELSE 0.3 * (o_orderkey % 5) / 4 + 0.3 * (o_orderkey % 3) / 2 + 0.2 * (o_custkey % 4) / 3 + 0.2 * least(1.0, (o_custkey % 10) / 200) END, 6) AS grade FROM orders")
def quiz_grades(spark, sf_dir):
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    grade = R.quiz_grade(key % 2 == 0, cust % 3 == 0, (key % 5) / 4, (key % 3) / 2, (cust % 4) / 3, cust % 10)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(grade, 6).alias("grade"))


@query("SELECT p_partkey, concat_ws(',', list_extract(o, CAST(p_partkey % 3 + 1 AS INT)), list_extract(o, CAST((p_partkey + 1) % 3 + 1 AS INT)), list_extract(o, CAST((p_partkey + 2) % 3 + 1 AS INT))) AS options FROM (SELECT p_partkey, [p_brand, p_type, p_name] AS o FROM part)")
def quiz_options(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(R.rotated(F.array("p_brand", "p_type", "p_name"), F.col("p_partkey").cast("int")), ",").alias("options"))


@query("SELECT p_brand, count(*) AS topics, count(CASE WHEN l.l_partkey IS NOT NULL THEN 1 END) AS covered, round(avg(CASE WHEN l.l_partkey IS NOT NULL THEN 1.0 ELSE 0 END), 6) AS share FROM part LEFT JOIN (SELECT DISTINCT l_partkey FROM lineitem WHERE l_quantity > 49) l ON l.l_partkey = p_partkey GROUP BY 1")
def curriculum_coverage(spark, sf_dir):
    used = table(spark, sf_dir, "lineitem").where("l_quantity > 49").select(F.col("l_partkey").alias("p_partkey")).distinct().withColumn("hit", F.lit(True))
    joined = table(spark, sf_dir, "part").join(used, "p_partkey", "left")
    return joined.groupBy("p_brand").agg(F.count("*").alias("topics"), F.count("hit").alias("covered"), F.round(F.avg(F.when(F.col("hit"), 1.0).otherwise(0.0)), 6).alias("share"))


@query("SELECT p_brand, p_partkey, p_name FROM (SELECT p_brand, p_partkey, p_name, row_number() OVER (PARTITION BY p_brand, p_name ORDER BY p_partkey) AS n FROM part WHERE p_size > 10) WHERE n = 1 ORDER BY p_brand, p_name, p_partkey LIMIT 50 OFFSET 25")
def article_sample(spark, sf_dir):
    first = table(spark, sf_dir, "part").where("p_size > 10").withColumn("n", F.row_number().over(Window.partitionBy("p_brand", "p_name").orderBy("p_partkey"))).where("n = 1")
    return first.orderBy("p_brand", "p_name", "p_partkey").offset(25).limit(50).select("p_brand", "p_partkey", "p_name")


@query("SELECT part, n, replace(CASE CAST(n % 3 AS INT) WHEN 0 THEN 'What is {}?' WHEN 1 THEN 'When does {} apply?' ELSE 'Who may use {}?' END, '{}', topic) AS question FROM (SELECT p_brand AS part, p_name AS topic, p_size, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS n FROM part) WHERE p_size % 2 = 0")
def seed_questions(spark, sf_dir):
    chunks = table(spark, sf_dir, "part").select(F.col("p_brand").alias("part"), "p_partkey", F.col("p_name").alias("topic"), "p_size")
    made = R.seed_questions(chunks, ["What is {}?", "When does {} apply?", "Who may use {}?"], F.col("p_size") % 2 == 0, ["p_partkey"])
    return made.select("part", F.col("n").cast("bigint").alias("n"), "question")


@query("SELECT source, run, days, days > 14 AS stale, days >= 7 AS due FROM (SELECT o_custkey % 50 AS source, o_orderkey AS run, datediff('day', CAST(o_orderdate AS DATE), DATE '2002-01-01') AS days, row_number() OVER (PARTITION BY o_custkey % 50 ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n <= 20")
def sync_report(spark, sf_dir):
    runs = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("source"), F.col("o_orderkey").alias("run"), F.col("o_orderdate").alias("finished"))
    return R.sync_state(runs, "2002-01-01").select("source", "run", F.col("days").cast("bigint").alias("days"), "stale", "due")


@query("SELECT o_orderkey, strftime(o_orderdate + INTERVAL 1 DAY * CASE o_orderstatus WHEN 'F' THEN 10 WHEN 'O' THEN 20 ELSE 15 END, '%Y-%m-%d') AS deadline FROM orders")
def appeal_deadlines(spark, sf_dir):
    kind = F.when(F.col("o_orderstatus") == "F", "hukm").when(F.col("o_orderstatus") == "O", "qaror").otherwise("other")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.date_format(R.next_deadline(kind, F.to_date("o_orderdate")), "yyyy-MM-dd").alias("deadline"))


@query("SELECT p_partkey, CAST(round(CAST(p_size * 0.5 + p_size * 16 / 64 * 0.1 + 2048 / 1024 * 0.5 + 1.0 AS DECIMAL(18, 9)), 2) AS DOUBLE) AS gb FROM part")
def memory_estimates(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", R.memory_gb(F.col("p_size"), F.lit(16), F.lit(2048)).alias("gb"))


@query("SELECT user_id, count(*) AS n, CASE WHEN count(*) * 1000 >= 1000000 THEN 'M' WHEN count(*) * 1000 >= 1000 THEN 'k' ELSE '' END AS unit FROM events GROUP BY 1")
def short_numbers(spark, sf_dir):
    counted = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    return counted.select("user_id", "n", F.regexp_extract(R.short_number(F.col("n") * 1000), "([kM]?)$", 1).alias("unit"))


@query("SELECT user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS surfaces, strftime(min(ts), '%Y-%m-%d') AS first_day, strftime(max(ts), '%Y-%m-%d') AS last_day FROM events GROUP BY 1")
def account_upsert(spark, sf_dir):
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_join(F.sort_array(F.collect_set("event_type")), ",").alias("surfaces"), day(F.min("ts")).alias("first_day"), day(F.max("ts")).alias("last_day"))


@query("SELECT source, count(*) AS chunks, CAST(sum(n_chars) AS BIGINT) AS size FROM documents GROUP BY 1 ORDER BY chunks DESC, source")
def store_stats(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("chunks"), F.sum("n_chars").alias("size")).orderBy(F.desc("chunks"), "source")


@query()
def key_digests(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", R.key_digest(F.col("c_name"), "secret").alias("digest"))


@query("SELECT kind, n_docs, n_docs >= 100 AS enough FROM (SELECT k.kind, count(d.lang) AS n_docs FROM (VALUES ('en'), ('fr'), ('de'), ('es'), ('uz')) k(kind) LEFT JOIN documents d ON d.lang = k.kind GROUP BY 1)")
def source_coverage(spark, sf_dir):
    from quillmesh.operators.graph import with_zero_classes

    counts = table(spark, sf_dir, "documents").groupBy(F.col("lang").alias("kind")).agg(F.count("*").alias("n"))
    return with_zero_classes(counts, "kind", ["en", "fr", "de", "es", "uz"]).select("kind", F.col("n").alias("n_docs"), (F.col("n") >= 100).alias("enough"))
