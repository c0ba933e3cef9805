"""Operators with state: limiters, hash chains, upserts and streams of text, for batches and for Structured Streaming.

The per-key folds are plain functions; batch queries run them over one key's ordered rows with applyInPandas, streaming
ones with applyInPandasWithState, so both give the same result.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

WINDOW_SECONDS = 60


def sliding_limiter(times: list[float], held: list[float], per_window: int, seconds: float = WINDOW_SECONDS) -> tuple[list[tuple[bool, float]], list[float]]:
    """(allowed, seconds to wait) for each hit, and the hits still held; refused hits are not recorded."""
    out = []
    for now in times:
        held = [t for t in held if t > now - seconds]
        if len(held) >= per_window:
            out.append((False, held[0] + seconds - now))
        else:
            held.append(now)
            out.append((True, 0.0))
    return out, held


def failure_window(times: list[float], state: tuple[int, float], most: int, seconds: float) -> tuple[list[bool], tuple[int, float]]:
    """Whether each failure is still tolerated; a window opens at the first failure and ends ``seconds`` later."""
    count, ends = state
    out = []
    for now in times:
        if now >= ends:
            count, ends = 0, now + seconds
        count += 1
        out.append(count <= most)
    return out, (count, ends)


def attempt_window(attempts: list[tuple[float, bool]], state: tuple[int, float], most: int, seconds: float) -> tuple[list[tuple[bool, int]], tuple[int, float]]:
    """(let through, failures so far) for each attempt (time, failed), and the state (failures, end of the window).

    A window opens at the first failure and holds up to and including its end; a success closes it. With ``most``
    failures in it an attempt is refused, and refused ones change nothing.
    """
    count, ends = state
    out = []
    for now, failed in attempts:
        if now > ends:
            count = 0
        allowed = count < most
        if allowed and failed:
            ends = ends if count else now + seconds
            count += 1
        elif allowed:
            count = 0
        out.append((allowed, count))
    return out, (count, ends)


GUARDED = "user_id bigint, event_id bigint, allowed boolean, failures int"


def _guard(rows: pd.DataFrame, key: str, state: tuple[int, float], most: int, seconds: float) -> tuple[pd.DataFrame, tuple[int, float]]:
    rows = rows.sort_values(["at", "event_id"])
    decided, state = attempt_window(list(zip(rows["at"].tolist(), rows["failed"].tolist(), strict=True)), state, most, seconds)
    return pd.DataFrame({"user_id": rows[key], "event_id": rows["event_id"], "allowed": [a for a, _ in decided], "failures": [n for _, n in decided]}), state


def guard_attempts(attempts: DataFrame, most: int, seconds: float, key: str = "user_id") -> DataFrame:
    """Each attempt (key, event_id, ts, failed) with whether failures before it let it through. A key's rows meet in one
    task, as each decision needs the ones before; null keys are one key."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        return _guard(frame, key, (0, 0.0), most, seconds)[0]

    return attempts.select(key, "event_id", seconds_of("ts").alias("at"), F.coalesce("failed", F.lit(False)).alias("failed")).groupBy(key).applyInPandas(run, GUARDED)


def guard_attempts_stream(attempts: DataFrame, most: int, seconds: float, late: str = "10 seconds", key: str = "user_id") -> DataFrame:
    """The same over a stream. A key's state ends when the watermark passes its window, or at a success, so keys without
    open windows hold none."""

    def run(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        out, held = _guard(pd.concat(list(frames)), key, state.get if state.exists else (0, 0.0), most, seconds)
        ends = int(held[1] * 1000) + 1
        if held[0] and ends > state.getCurrentWatermarkMs():
            state.update(held)
            state.setTimeoutTimestamp(ends)
        elif state.exists:
            state.remove()
        yield out

    rows = attempts.select(key, "event_id", F.col("ts").cast("timestamp").alias("ts"), seconds_of("ts").alias("at"), F.coalesce("failed", F.lit(False)).alias("failed")).withWatermark("ts", late)
    return rows.groupBy(key).applyInPandasWithState(run, GUARDED, "failures int, ends double", "append", GroupStateTimeout.EventTimeTimeout)


def seconds_of(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp")) / 1e6


LIMITED = "user_id bigint, event_id bigint, allowed boolean, wait double"


def limit_rate(events: DataFrame, per_window: int, key: str = "user_id", ts: str = "ts") -> DataFrame:
    """Each event of a key with whether a sliding window of hits lets it through. A key's rows meet in one task, as each decision needs the ones before."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["at", "event_id"])
        decided, _ = sliding_limiter(frame["at"].tolist(), [], per_window)
        return pd.DataFrame({"user_id": frame[key], "event_id": frame["event_id"], "allowed": [a for a, _ in decided], "wait": [round(w, 6) for _, w in decided]})

    return events.select(F.col(key), "event_id", seconds_of(ts).alias("at")).groupBy(key).applyInPandas(run, LIMITED)


def limit_rate_stream(events: DataFrame, per_window: int, key: str = "user_id", ts: str = "ts") -> DataFrame:
    """The same over a stream: the hits still held are the state."""

    def run(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(frames)).sort_values(["at", "event_id"])
        decided, held = sliding_limiter(rows["at"].tolist(), held, per_window)
        state.update((held,))
        yield pd.DataFrame({"user_id": rows[key], "event_id": rows["event_id"], "allowed": [a for a, _ in decided], "wait": [round(w, 6) for _, w in decided]})

    return events.select(F.col(key), "event_id", seconds_of(ts).alias("at")).groupBy(key).applyInPandasWithState(run, LIMITED, "held array<double>", "append", GroupStateTimeout.NoTimeout)


def record_hash(body: dict, previous: str) -> str:
    text = json.dumps(body, sort_keys=True, ensure_ascii=False, separators=(",", ":"))
    return hashlib.sha256(f"{previous}\n{text}".encode()).hexdigest()


CHAIN = "chain string, seq bigint, body string, prev string, hash string"


def hash_chain(records: DataFrame, chain: str, order: str, columns: list[str]) -> DataFrame:
    """An append-only log: each record's hash covers its columns and the hash before, one chain for each value of ``chain``."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(order)
        previous, out = "", []
        for seq, row in enumerate(frame[columns].itertuples(index=False, name=None)):
            body = {c: str(v) for c, v in zip(columns, row, strict=True)}
            digest = record_hash(body, previous)
            out.append((str(frame[chain].iloc[0]), seq, json.dumps(body, sort_keys=True, ensure_ascii=False, separators=(",", ":")), previous, digest))
            previous = digest
        return pd.DataFrame(out, columns=["chain", "seq", "body", "prev", "hash"])

    return records.select(*dict.fromkeys([chain, order, *columns])).groupBy(chain).applyInPandas(run, CHAIN)


def verify_chain(log: DataFrame) -> DataFrame:
    """(chain, records, first_break): the first record whose own hash or link to the one before is wrong; null if none. All in the JVM."""
    from pyspark.sql import Window

    before = F.coalesce(F.lag("hash").over(Window.partitionBy("chain").orderBy("seq")), F.lit(""))
    checked = log.withColumn("bad", (F.col("prev") != before) | (F.sha2(F.concat_ws("\n", "prev", "body"), 256) != F.col("hash")))
    return checked.groupBy("chain").agg(F.count("*").alias("records"), F.min(F.when(F.col("bad"), F.col("seq"))).alias("first_break"))


def merge_actors(known: DataFrame, fresh: DataFrame, key: str = "user_id") -> DataFrame:
    """Two actor tables (key, first_seen, last_seen, requests) as one."""
    return known.unionByName(fresh).groupBy(key).agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.sum("requests").alias("requests"))


def actor_upsert_writer(path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that keeps the actor table under path, one version a batch; a batch done twice changes nothing."""

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        fresh = batch.groupBy("user_id").agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count("*").alias("requests"))
        merged = merge_actors(spark.read.parquet(f"{path}/v{epoch - 1}"), fresh) if epoch else fresh
        merged.write.mode("overwrite").parquet(f"{path}/v{epoch}")

    return write


def windowed_counts(events: DataFrame, late: str = "1 hour", width: str = "1 hour") -> DataFrame:
    """Events by window and type, late ones within the watermark counted."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def expire(df: DataFrame, ts: str, ttl_seconds: int, now: str) -> DataFrame:
    """Rows whose time to live is not over."""
    return df.where(F.col(ts) + F.make_dt_interval(secs=F.lit(ttl_seconds)) > F.to_timestamp(F.lit(now)))


def session_totals(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """A record for each stretch of a user's events without a longer gap: what a tap on a stream writes at its end."""
    return events.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select("user_id", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("started"), "n", "total")


def polish_pieces(pieces: list[str], carried: str = "") -> tuple[list[str], str]:
    """Pieces of a stream with apostrophes mended; a last o or g waits for the piece after it."""
    import re

    out = []
    for piece in pieces:
        text = carried + piece
        carried = text[-1] if text[-1:] in "oOgG" and text else ""
        text = text[: len(text) - len(carried)]
        out.append(re.sub("(?<=[oOgG])['‘’`´′ʼ]", "ʻ", text))
    return out, carried


def polish_stream(pieces: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """(key, order, text) with what is carried put out at the end of each key."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(order)
        done, carried = polish_pieces(frame[text].tolist())
        done[-1] += carried
        return pd.DataFrame({key: frame[key], order: frame[order], text: done})

    return pieces.select(key, order, text).groupBy(key).applyInPandas(run, pieces.select(key, order, text).schema)
