import datetime as dt

from pyspark.sql import functions as F

from quillmesh.streaming import state as S

SCHEMA = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double"


def events(spark):
    start = dt.datetime(2024, 1, 1)
    rows = [(i, start + dt.timedelta(seconds=20 * i), i % 2, "click", 1.0) for i in range(12)]
    return spark.createDataFrame(rows, SCHEMA)


def run_stream(spark, df, tmp_path, name, mode="append"):
    out = str(tmp_path / name)
    query = df.writeStream.outputMode(mode).format("parquet").option("path", out).option("checkpointLocation", out + "-c").trigger(availableNow=True).start()
    query.awaitTermination(120)
    return spark.read.parquet(out)


def test_refused_hits_are_not_recorded():
    decided, held = S.sliding_limiter([0, 10, 20, 61, 62], [], 2)
    assert [a for a, _ in decided] == [True, True, False, True, False] and decided[2][1] == 40
    assert held == [10, 61]


def test_failure_window_opens_at_the_first_failure():
    allowed, state = S.failure_window([100, 110, 120, 161], (0, 0.0), 2, 60)
    assert allowed == [True, True, False, True] and state == (1, 221)


def attempts(spark):
    """(user_id, event_id, seconds, failed)."""
    rows = [(1, 1, 0, True), (1, 2, 10, True), (1, 3, 20, False), (1, 4, 60, True), (1, 5, 61, True), (1, 6, 62, False), (1, 7, 70, True), (2, 1, 5, True), (2, 2, 6, False), (2, 3, 7, True), (None, 1, 8, None)]
    return spark.createDataFrame(rows, "user_id bigint, event_id bigint, s int, failed boolean").select("user_id", "event_id", (F.timestamp_seconds(F.col("s") + 1000)).alias("ts"), "failed")


def test_attempts_are_refused_within_the_window(spark):
    rows = {(r.user_id, r.event_id): (r.allowed, r.failures) for r in S.guard_attempts(attempts(spark), 2, 60).collect()}
    first = {1: (True, 1), 2: (True, 2), 3: (False, 2), 4: (False, 2), 5: (True, 1), 6: (True, 0), 7: (True, 1)}
    assert {e: v for (u, e), v in rows.items() if u == 1} == first
    assert {e: v for (u, e), v in rows.items() if u == 2} == {1: (True, 1), 2: (True, 0), 3: (True, 1)} and rows[None, 1] == (True, 0)


def test_limits_are_in_seconds(spark):
    hits = spark.createDataFrame([(1, i, s) for i, s in enumerate((0, 10, 20, 61, 62))], "user_id bigint, event_id bigint, s int").select("user_id", "event_id", F.timestamp_seconds("s").alias("ts"))
    assert [(r.allowed, r.wait) for r in S.limit_rate(hits, 2).orderBy("event_id").collect()] == [(True, 0), (True, 0), (False, 40), (True, 0), (False, 8)]


def test_attempt_state_ends_with_its_window(spark, tmp_path):
    """A stream in batches equals the batch, and keys without an open window hold no state."""
    rows = attempts(spark).where("user_id IS NOT NULL").unionByName(spark.sql("SELECT 9L AS user_id, 1L AS event_id, timestamp_seconds(1500) AS ts, true AS failed"))
    source = str(tmp_path / "in")
    schema = "user_id bigint, event_id bigint, ts timestamp, failed boolean"
    for low, high in ((0, 1015), (1015, 1065), (1065, 1100), (1100, 2000)):
        part = rows.where(F.unix_seconds("ts").between(low, high - 1)).coalesce(1)
        part.write.mode("append").parquet(source)
    streamed = S.guard_attempts_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(source), 2, 60, "1 second")
    out = run_stream(spark, streamed, tmp_path, "out")
    key = lambda df: sorted((r.user_id, r.event_id, r.allowed, r.failures) for r in df.collect())
    assert key(out) == key(S.guard_attempts(rows, 2, 60))
    rest = spark.read.format("statestore").load(str(tmp_path / "out-c")).select("key.user_id").collect()
    assert {r.user_id for r in rest} == {9}


def test_limiter_is_the_same_in_batch_and_stream(spark, tmp_path):
    source = tmp_path / "in"
    events(spark).write.parquet(str(source))
    batch = {(r.event_id, r.allowed) for r in S.limit_rate(events(spark), 1).collect()}
    streamed = S.limit_rate_stream(spark.readStream.schema(SCHEMA).parquet(str(source)), 1)
    assert {(r.event_id, r.allowed) for r in run_stream(spark, streamed, tmp_path, "out").collect()} == batch


def test_chain_breaks_where_a_record_is_changed(spark):
    log = S.hash_chain(events(spark), "user_id", "event_id", ["event_id", "event_type"])
    assert [r.first_break for r in S.verify_chain(log).collect()] == [None, None]
    broken = log.withColumn("body", F.when((F.col("chain") == "1") & (F.col("seq") == 2), F.lit("{}")).otherwise(F.col("body")))
    assert {r.chain: r.first_break for r in S.verify_chain(broken).collect()} == {"0": None, "1": 2}


def test_actor_upsert_counts_each_batch_once(spark, tmp_path):
    write = S.actor_upsert_writer(str(tmp_path / "actors"))
    df = events(spark)
    write(df.where("event_id < 6"), 0)
    write(df.where("event_id >= 6"), 1)
    write(df.where("event_id >= 6"), 1)
    assert {r.user_id: r.requests for r in spark.read.parquet(str(tmp_path / "actors/v1")).collect()} == {0: 6, 1: 6}


def test_carried_letters():
    assert S.polish_pieces(["o", "'zbek g", "‘oya"]) == (["", "oʻzbek ", "gʻoya"], "")
