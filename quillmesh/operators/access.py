"""Sessions and keys: who a token stands for, and which sessions end with a user."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def token_digests(tokens: DataFrame, token: str = "token") -> DataFrame:
    """tokens with the digest that is stored in their place."""
    return tokens.withColumn("token_hash", F.sha2(F.col(token).cast("binary"), 256))


def session_users(tokens: DataFrame, sessions: DataFrame, users: DataFrame, now: str) -> DataFrame:
    """(request_id, user_id) of tokens (request_id, token) of a session (token_hash, user_id, expires_at) that hasn't ended,
    whose user (user_id, blocked) is there and isn't blocked. Other tokens give no row."""
    live = sessions.where(F.col("expires_at") > F.to_timestamp(F.lit(now))).select("token_hash", "user_id")
    known = users.where(~F.coalesce("blocked", F.lit(False))).select("user_id")
    return token_digests(tokens).join(live, "token_hash").join(known, "user_id", "left_semi").select("request_id", "user_id")


def sessions_left(sessions: DataFrame, ended: DataFrame, now: str) -> DataFrame:
    """Sessions without those of the users (user_id) whose sessions are ended, and without those that ran out."""
    return sessions.where(F.col("expires_at") > F.to_timestamp(F.lit(now))).join(ended.select("user_id"), "user_id", "left_anti")
