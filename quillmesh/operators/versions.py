"""Version history: amendment notes read, and validity intervals built from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.functions import text as T

# What the folded text of a note says.
PUBLICATION = r"(?U)o'r qht|oliy majlis\w*\s+axborotnoma|palatalarining\s+axborotnoma|qonun\w*\s+hujjatlari\s+ma'lumotlari\s+milliy\s+bazasi|qonunchilik\s+ma'lumotlari\s+milliy\s+bazasi|qonun\s+hujjatlari\s+to'plami|ведомости|собрание\s+законодательства"
SIGNAL = r"(?U)tahririda|kuchini\s+yo'qot|chiqarib\s+tashlangan|to'ldirilgan|kiritilgan|утратил|исключен|дополнен|внесены\s+изменения"
REPEALED = r"(?U)kuchini\s+yo'qot|утратил\w*\s+силу"
REMOVED = r"(?U)chiqarib\s+tashlangan|исключен"
ADDED = r"(?U)to'ldirilgan|kiritilgan|дополнен"
EDITED = r"(?U)tahririda"
STRUCTURE = r"(?U)(?:\d+|[ivxl]+)\s*-?\s*(?:bob|bo'lim)\b|paragraf|\bглав[аы]\b"
TARGET_RUN = r"(?U)((?:\d+(?:-\d+)?\s*(?:,|\bva\b|\bhamda\b|—|–|(?<=\s)-(?=\s))\s*)*\d+(?:-\d+)?)-modda"
RUSSIAN_TARGET = r"(?U)стать[юяие]\s+(\d+(?:-\d+)?)"
AMENDING_ACT = r"(?U)\b(?:o'rq|zru|зру|ўрқ)[-\s]?(\d+)|\b(\d+)-(i{1,3}|iv|v)-son"
FORCE_DATE = r"(?U)kuchga\s+kirish\s+sanasi\s*[-–—:]?\s*([^)]{6,45})"
FORCE_FROM = r"(?U)((?:\d{4}[-\s]?yil\s+)?\d{1,2}[-\s]?\w+|\d{1,2}\.\d{2}\.\d{4})dan\s+kuchga\s+kirad"
REPEAL_DATE = r"(?U)kuchini\s+yo'qotish\s+sanasi\s*[-–—:]?\s*([^)]{6,45})"
LAW_DATE = r"(?U)(\d{4}-yil\s+\d{1,2}-\w+)dagi"


def note_head(folded: Column) -> Column:
    """A note up to where its publication is named."""
    at = F.regexp_instr(folded, F.lit(PUBLICATION))
    return F.when(at > 0, F.substr(folded, F.lit(1), at - 1)).otherwise(folded)


def note_targets(head: Column) -> Column:
    """Article numbers a head names, runs spread out, first named first."""
    runs = F.flatten(F.transform(F.regexp_extract_all(head, F.lit(TARGET_RUN), F.lit(1)), T.expand_articles))
    return F.array_distinct(F.concat(runs, F.regexp_extract_all(head, F.lit(RUSSIAN_TARGET), F.lit(1))))


def amending_act(folded: Column) -> Column:
    group = lambda i: F.nullif(F.regexp_extract(folded, AMENDING_ACT, i), F.lit(""))
    return F.coalesce(F.concat(F.lit("OʻRQ-"), group(1)), F.concat(group(2), F.lit("-"), F.upper(group(3))))


def effective_date(folded: Column, kind: Column) -> Column:
    """A repeal's own date, else when it comes into force, else the amending act's date, else any date."""
    said = lambda p: T.extract_date(F.regexp_extract(folded, p, 1))
    return F.coalesce(F.when(kind == "repealed", said(REPEAL_DATE)), said(FORCE_DATE), said(FORCE_FROM), said(LAW_DATE), T.extract_date(folded))


def parse_notes(notes: DataFrame, text: str = "text", fallback: str = "fallback") -> DataFrame:
    """Notes with kind, targets, effective_date and amending_act; those that say nothing, or can't be tied to an article, go.

    A repeal or a note on a whole chapter without a named article is dropped; others fall back to the enclosing article.
    """
    read = notes.withColumn("folded", T.fold(text)).where(F.col("folded").rlike(SIGNAL)).withColumn("head", note_head(F.col("folded"))).withColumn("named", note_targets(F.col("head")))
    kind = F.when(F.col("head").rlike(REPEALED), "repealed").when(F.col("head").rlike(REMOVED), "removed").when(F.col("head").rlike(ADDED) & ~F.col("head").rlike(EDITED), "added").otherwise("edition")
    read = read.withColumn("kind", kind)
    lost = (F.size("named") == 0) & ((F.col("kind") == "repealed") | F.col("head").rlike(STRUCTURE) | F.col(fallback).isNull())
    read = read.where(~lost).withColumn("targets", F.when(F.size("named") > 0, F.col("named")).otherwise(F.array(fallback)))
    return read.withColumn("effective_date", effective_date(F.col("folded"), F.col("kind"))).withColumn("amending_act", amending_act(F.col("folded"))).drop("folded", "head", "named")


def build_versions(signals: DataFrame, today: str, keys: list[str]) -> DataFrame:
    """One row a key: last edition so far, earliest repeal, earliest edition to come, status and number of notes.

    signals: keys, kind, effective_date. A repeal without a date sets the status alone.
    """
    change = F.col("kind").isin("edition", "added", "removed")
    past, future = F.col("effective_date") <= today, F.col("effective_date") > today
    return signals.groupBy(*keys).agg(
        F.max(F.when(change & past, F.col("effective_date"))).alias("valid_from"),
        F.min(F.when(F.col("kind") == "repealed", F.col("effective_date"))).alias("valid_to"),
        F.min(F.when(change & future, F.col("effective_date"))).alias("pending_from"),
        F.when(F.bool_or(F.col("kind") == "repealed"), "repealed").otherwise("in_force").alias("status"),
        F.count("*").alias("note_count"),
    )


def apply_versions(elements: DataFrame, versions: DataFrame, keys: list[str]) -> DataFrame:
    return elements.join(versions, keys, "left").withColumn("status", F.coalesce("status", F.lit("in_force")))


def repealed_absent(versions: DataFrame, elements: DataFrame, keys: list[str]) -> DataFrame:
    return versions.where(F.col("valid_to").isNotNull()).join(elements.select(*keys), keys, "left_anti")


def valid_from_or_adopted(valid_from: Column, adopted: Column, today: str) -> Column:
    return F.coalesce(valid_from, F.when(adopted <= today, adopted))
