"""Aggregations: usage, events, retrieval quality, panels and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def event_summary(events: DataFrame, now: str, hours: int, ts: str = "ts", value: str = "value", error: Column | None = None) -> DataFrame:
    """Totals over the hours before now."""
    window = events.where((F.col(ts) >= F.to_timestamp(F.lit(now)) - F.expr(f"make_interval(0, 0, 0, 0, {hours})")) & (F.col(ts) <= F.to_timestamp(F.lit(now))))
    return window.agg(F.count("*").alias("n_events"), F.round(F.sum(F.coalesce(value, F.lit(0.0))), 4).alias("total_value"), F.round(F.avg(value), 6).alias("mean_value"), F.count_if(error if error is not None else F.lit(False)).alias("n_errors"))


def nearest_ranks(df: DataFrame, value: str) -> DataFrame:
    """Upper median and nearest-rank 95th percentile: values number n // 2 and min(floor(.95 n), n - 1), counted from 0.

    Ranks come from counts by value, so only distinct values meet in one task's running sum by buckets of the range.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("n"))
    bounds = counts.agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.sum("n").alias("total"))
    placed = counts.crossJoin(F.broadcast(bounds)).withColumn("bucket", F.when(F.col("hi") > F.col("lo"), F.floor((F.col(value) - F.col("lo")) / (F.col("hi") - F.col("lo")) * 1000)).otherwise(0))
    sums = placed.groupBy("bucket").agg(F.sum("n").alias("inside"))
    before = sums.withColumn("before", F.coalesce(F.sum("inside").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("inside")  # 1001 rows at most
    upto = F.col("before") + F.sum("n").over(Window.partitionBy("bucket").orderBy(value))
    ended = placed.join(F.broadcast(before), "bucket").withColumn("upto", upto)
    median, p95 = F.floor(F.col("total") / 2) + 1, F.least(F.floor(F.col("total") * 0.95), F.col("total") - 1) + 1
    return ended.agg(F.min(F.when(F.col("upto") >= median, F.col(value))).alias("median"), F.min(F.when(F.col("upto") >= p95, F.col(value))).alias("p95"), F.sum("n").alias("n"))


def first_relevant(results: DataFrame, relevant: DataFrame, key: str) -> DataFrame:
    """(query_id, first_rank) of each query's first relevant result, null without one."""
    hits = results.join(relevant, ["query_id", key]).groupBy("query_id").agg(F.min("rank").alias("first_rank"))
    return relevant.select("query_id").distinct().join(hits, "query_id", "left")


def recall_and_mrr(first: DataFrame) -> DataFrame:
    share = lambda k: F.round(F.avg(F.when(F.col("first_rank") <= k, 1.0).otherwise(0.0)), 6)
    return first.agg(F.count("*").alias("n_queries"), share(1).alias("recall_1"), share(3).alias("recall_3"), share(10).alias("recall_10"), F.round(F.avg(F.coalesce(1 / F.col("first_rank"), F.lit(0.0))), 6).alias("mrr"))


def usage(events: DataFrame, user: str, day: Column, endpoint: str) -> DataFrame:
    return events.groupBy(F.col(user).alias("user_id"), day.alias("day"), F.col(endpoint).alias("endpoint")).agg(F.count("*").alias("n"))


def access(feature: Column, daily: Column, monthly: Column, used_today: Column, used_month: Column, billing: bool = True) -> Column:
    """allow, feature, daily or monthly: what stands in a request's way first. A null limit is none."""
    if not billing:
        return F.lit("allow")
    return F.when(~feature, "feature").when(used_today >= daily, "daily").when(used_month >= monthly, "monthly").otherwise("allow")


def actor_table(events: DataFrame, user: str = "user_id", ts: str = "ts") -> DataFrame:
    return events.groupBy(user).agg(F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen"), F.count("*").alias("requests"))


def panel_decision(verdicts: DataFrame, key: str = "sample") -> DataFrame:
    """rejected where half reject; accepted where all accept with confidence of .75 at least; else unclear. And their agreement."""
    counted = verdicts.groupBy(key).agg(F.count("*").alias("n"), F.count_if(F.col("verdict") == "accept").alias("accepts"), F.count_if(F.col("verdict") == "reject").alias("rejects"), F.min("confidence").alias("least"))
    decision = F.when(2 * F.col("rejects") >= F.col("n"), "rejected").when((F.col("accepts") == F.col("n")) & (F.col("least") >= 0.75), "accepted").otherwise("unclear")
    return counted.select(key, "n", decision.alias("decision"), F.round(F.greatest("accepts", "rejects", F.col("n") - F.col("accepts") - F.col("rejects")) / F.col("n"), 6).alias("agreement"))


def spot_check(key: Column, percent: int = 15) -> Column:
    """A fixed share of keys, the same at every run."""
    return F.pmod(F.xxhash64(key), F.lit(100)) < percent


def power_mean(scores: Column, p: float = 1.5) -> Column:
    return F.least(F.lit(1.0), F.pow(F.avg(F.pow(F.round(scores, 2), p)), 1 / p))


def risk_label(score: Column) -> Column:
    return F.when(score >= 0.7, "high").when(score >= 0.4, "medium").when(score >= 0.15, "low").otherwise("none")


def severity_counts(findings: DataFrame, key: str, severity: str, classes: list[str]) -> DataFrame:
    """One column a class, zeros included."""
    return findings.groupBy(key).agg(*[F.count_if(F.col(severity) == c).alias(f"n_{c}") for c in classes])


def page_of(df: DataFrame, order: list, offset: int, limit: int) -> DataFrame:
    """A page of the rows in order, each with the number of all rows."""
    total = df.agg(F.count("*").alias("total"))
    return df.orderBy(*order).offset(offset).limit(limit).crossJoin(F.broadcast(total))


def own_history(turns: DataFrame, user: Column, session: Column, offset: int, limit: int, order: list) -> DataFrame:
    """A page of the turns (user_id, session_id) of either identity, in order, each with the number of all of them."""
    mine = F.coalesce(F.col("user_id") == user, F.lit(False)) | F.coalesce(F.col("session_id") == session, F.lit(False))
    return page_of(turns.where(mine), order, offset, limit)


def gate_counts(answers: DataFrame, trace: DataFrame, key: str = "answer_id") -> DataFrame:
    """answers with what the gate kept and dropped, read from their trace (key, step, node, kept, dropped): the last gate step
    counts, and an answer without one has zeros."""
    gates = trace.where("node = 'gate'").groupBy(key).agg(F.max_by(F.struct("kept", "dropped"), "step").alias("g"))
    return answers.join(gates, key, "left").withColumn("gate_kept", F.coalesce("g.kept", F.lit(0))).withColumn("gate_dropped", F.coalesce("g.dropped", F.lit(0))).drop("g")


def disagreement(confidence_a: Column, confidence_b: Column, tags_a: Column, tags_b: Column, conclusions: Column) -> Column:
    """0.4 of the difference of confidence, 0.4 of the tags' distance and 0.2 of the conclusions'."""
    from quillmesh.functions.text import jaccard

    return 0.4 * F.abs(confidence_a - confidence_b) + 0.4 * (1 - jaccard(tags_a, tags_b)) + 0.2 * conclusions
