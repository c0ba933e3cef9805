"""Data quality: rules over elements and samples, and their summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.functions import text as T

QUARANTINE, DROP = ("PII", "LOW_CONFIDENCE"), ("DUPLICATE", "EMPTY")


def findings(df: DataFrame, keys: list[str], rules: list[tuple[str, str, Column]], last: str | None = None) -> DataFrame:
    """(keys, code, severity) for every rule (code, severity, condition) that holds; if rule ``last`` holds, later ones don't count."""
    made, stopped = [], F.lit(False)
    for code, severity, condition in rules:
        made.append(F.when(F.coalesce(condition, F.lit(False)) & ~stopped, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"))))
        if code == last:
            stopped = F.coalesce(condition, F.lit(False))
    return df.select(*keys, F.explode(F.filter(F.array(*made), lambda x: x.isNotNull())).alias("f")).select(*keys, "f.*")


# Codes of element checks with their severity, and the limits that they use.
ELEMENT_CODES = {
    "modda_raqami_yoq": "error", "modda_takrorlanadi": "error", "ierarxiya_nomuvofiq": "error", "sana_kelajakda": "error", "sana_mantiqsiz": "error",
    "matn_qisqa": "error", "kirill_qoldigi": "warning", "apostrof_nokanonik": "warning", "pii_topildi": "error", "bekor_qilingan_matnda": "error",
}
QUARANTINE_CODES = ("modda_raqami_yoq", "modda_takrorlanadi", "ierarxiya_nomuvofiq", "sana_kelajakda", "sana_mantiqsiz", "pii_topildi", "bekor_qilingan_matnda")
LEAST_BODY, MOST_CYRILLIC = 20, 0.02


def element_findings(elements: DataFrame, versions: DataFrame, today: str, personal: Column | None = None) -> DataFrame:
    """(doc_id, pos, code, severity) of articles: numbers that lack or repeat, headers that no path step names, dates,
    short bodies (which end the checks of their text), leftovers of another script, apostrophes, personal data, and
    articles that a version (doc_id, article, status) calls repealed and the text still has.

    elements: doc_id, pos, level, title, article, path, body, lang, valid_from, valid_to. personal: whether a body holds
    personal data; without it this is not checked. Of a repeated number the last article counts as the one that stands.
    """
    number = F.coalesce("article", F.lit(""))
    articles = elements.where("level = 'article'")
    by_number = Window.partitionBy("doc_id", "article")
    gaps = path_gaps(elements).select("doc_id", "pos", F.lit(True).alias("gap"))
    repealed = versions.where("status = 'repealed'").select("doc_id", "article").distinct().withColumn("repealed", F.lit(True))
    read = articles.withColumn("again", (number != "") & (F.row_number().over(by_number.orderBy("pos")) > 1)).withColumn("stands", F.col("pos") == F.max("pos").over(by_number))
    read = read.join(gaps, ["doc_id", "pos"], "left").join(repealed, ["doc_id", "article"], "left")
    rules = {
        "modda_raqami_yoq": number == "",
        "modda_takrorlanadi": F.col("again"),
        "ierarxiya_nomuvofiq": F.col("gap"),
        "sana_kelajakda": F.col("valid_from") > today,
        "sana_mantiqsiz": F.col("valid_from") >= F.col("valid_to"),
        "bekor_qilingan_matnda": F.col("repealed") & F.col("stands") & (number != ""),
        "matn_qisqa": F.length(T.strip("body")) < LEAST_BODY,
        "kirill_qoldigi": (F.col("lang") == "uz") & (T.cyrillic_ratio("body") > MOST_CYRILLIC),
        "apostrof_nokanonik": F.col("body").rlike("['‘’`´′]"),
        "pii_topildi": F.lit(False) if personal is None else personal,
    }
    return findings(read, ["doc_id", "pos"], [(code, ELEMENT_CODES[code], condition) for code, condition in rules.items()], last="matn_qisqa")


def quarantined(found: DataFrame, keys: list[str]) -> DataFrame:
    """The keys of rows that wait for a person."""
    return found.where(F.col("code").isin(*QUARANTINE_CODES)).select(*keys).distinct()


def summary(found: DataFrame, keys: list[str]) -> DataFrame:
    """(code, severity, n, n_keys) by code."""
    return found.groupBy("code", "severity").agg(F.count("*").alias("n"), F.countDistinct(*keys).alias("n_keys"))


def first_reason(conditions: list[tuple[str, Column]]) -> Column:
    """The first reason that holds, null if none does."""
    out = None
    for reason, condition in conditions:
        out = F.when(condition, reason) if out is None else out.when(condition, reason)
    return out


def path_gaps(elements: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, pos, step): the first step of an element's path that no header of its document has."""
    headers = elements.where("level <> 'article'").select(key, F.lower("title").alias("step")).distinct()
    steps = elements.where("level = 'article'").select(key, "pos", F.posexplode("path").alias("n", "name")).select(key, "pos", "n", F.lower("name").alias("step"))
    missing = steps.join(headers, [key, "step"], "left_anti")
    return missing.groupBy(key, "pos").agg(F.min_by("step", "n").alias("step"))


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), F.coalesce(x.try_cast("double"), F.lit(low))))
