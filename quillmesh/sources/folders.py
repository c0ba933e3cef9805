"""Folders of files: corpora to be cut and indexed, court decisions, and configuration with defaults where it is absent.

Spark itself passes over files of no bytes and those whose names begin with a dot or an underscore; files in folders that begin with a dot are
left out here. Folders are listed by Spark's readers, so any store that these reach will do.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.functions import text as T
from quillmesh.operators.chunking import article_texts
from quillmesh.sources.archive import extracted_text, file_name_parts

# Endings of files whose text can be read.
READABLE = ("txt", "md", "markdown", "html", "htm")


def folder_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, name, kind, size, content, readable) of all files in a folder and those below, but for names with a leading
    dot. A folder that isn't there raises an error; content is read only where it is asked for."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    parts = F.split("path", "/", -1)
    inside = F.size(F.split(F.regexp_replace(F.lit(folder), "^[a-z0-9]+:/*|^/*|/*$", ""), "/", -1))
    shown = files.withColumn("parts", F.filter(F.split(F.regexp_replace("path", "^[a-z0-9]+:/*", ""), "/", -1), lambda p: p != ""))
    shown = shown.where(~F.exists(F.slice("parts", inside + 1, F.size("parts")), lambda p: p.startswith(".")))
    name = F.element_at(parts, -1)
    kind = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    return shown.select("path", name.alias("name"), kind.alias("kind"), F.col("length").alias("size"), "content", kind.isin(*READABLE).alias("readable"))


def documents_of(files: DataFrame) -> DataFrame:
    """(path, document, url, version, text) of the readable files, in the form that is indexed."""
    named = file_name_parts(F.regexp_replace("name", r"\.[^.]+$", ""))
    kind = F.when(F.col("kind").isin("html", "htm"), "html").otherwise(F.col("kind"))
    return files.where("readable").select("path", *named, extracted_text(F.decode("content", "UTF-8"), kind).alias("text"))


def ingest_folder(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Chunks (path, document, url, version, pos, article, heading, text), and a summary of one row: files, chunks, the
    names of files that can't be read, sorted, and the documents, in the order of their first file."""
    files = folder_files(spark, folder)
    documents = documents_of(files)
    chunks = documents.drop("text").join(article_texts(documents, "path"), "path")
    counted = chunks.agg(F.count("*").alias("chunks"))
    skipped = F.sort_array(F.collect_list(F.when(~F.col("readable"), F.col("name"))))
    seen = files.drop("content").agg(F.count_if("readable").alias("files"), skipped.alias("skipped"))
    first = documents.groupBy("document").agg(F.min("path").alias("path"))
    listed = first.agg(F.transform(F.sort_array(F.collect_list(F.struct("path", "document"))), lambda x: x["document"]).alias("documents"))
    return chunks, seen.crossJoin(counted).crossJoin(listed)  # one row each


def read_decisions(spark: SparkSession, folder: str, pattern: str = "*.txt") -> DataFrame:
    """(name, text, notice) of a folder's own files that match a pattern, one row a file; an empty one has a notice and no
    text. Raises an error where nothing can be read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    body = F.decode("content", "UTF-8")
    empty = T.strip(body) == ""
    read = files.select(F.element_at(F.split("path", "/", -1), -1).alias("name"), F.when(~empty, body).alias("text"), F.when(empty, "empty").alias("notice"))
    if read.where("text IS NOT NULL").isEmpty():
        raise ValueError(f"no decision to read in {folder} ({pattern})")
    return read


def read_setting(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A configuration file (JSON lines) as a table; an absent one is an empty table, a line that can't be read an error."""
    try:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_routing(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Triggers (domain, trigger, weight) and documents (domain, pos, document) of lines (domain, weight, triggers,
    documents), folded; a domain that lacks either is left out. Without the file nothing is routed."""
    domains = read_setting(spark, path, "domain string, weight double, triggers array<string>, documents array<string>").where("size(triggers) > 0 AND size(documents) > 0")
    triggers = domains.select("domain", F.explode("triggers").alias("trigger"), F.coalesce("weight", F.lit(1.0)).alias("weight"))
    documents = domains.select("domain", F.posexplode("documents").alias("pos", "document"))
    return triggers.withColumn("trigger", T.fold("trigger")), documents.withColumn("document", T.fold("document"))


LAYERED = "keys array<string>, value string"


def flattened(layers: DataFrame, key: str = "key", layer: str = "layer", text: str = "config") -> DataFrame:
    """(key, layer, keys, value) of every leaf of JSON objects: keys lead to it, value is its JSON text; lists and empty
    objects are leaves. Objects are opened level by level, as many times as the deepest one asks."""
    inside = lambda v: F.from_json(v, "map<string,string>")
    is_object = lambda v: v.startswith("{") & (F.regexp_replace(v, r"\s", "") != "{}")
    level = layers.select(key, layer, F.array().cast("array<string>").alias("keys"), F.trim(text).alias("value"))
    out = None
    while True:
        leaves = level.where(~is_object(F.col("value")))
        out = leaves if out is None else out.unionByName(leaves)
        opened = level.where(is_object(F.col("value")))
        if opened.isEmpty():
            return out
        level = opened.select(key, layer, "keys", F.explode(inside(F.col("value"))).alias("name", "value")).select(key, layer, F.array_append("keys", F.col("name")).alias("keys"), F.coalesce("value", F.lit("null")).alias("value"))


def merged_settings(layers: DataFrame, key: str = "key", layer: str = "layer", text: str = "config") -> DataFrame:
    """(key, path, value): objects laid over each other in the order of layer; a later leaf takes the place of an earlier
    one, and of all that stood below it, and an object the place of an earlier leaf above it."""
    leaves = flattened(layers, key, layer, text)
    last = leaves.groupBy(key, "keys").agg(F.max(layer).alias("at"), F.max_by("value", layer).alias("value"))
    above = last.select(key, "keys", "at", "value", F.explode_outer(F.transform(F.sequence(F.lit(0), F.size("keys") - 1), lambda n: F.slice("keys", 1, n))).alias("prefix"))
    shorter = last.select(key, F.col("keys").alias("prefix"), F.col("at").alias("over"))
    covered = above.join(shorter, [key, "prefix"]).where("over > at").select(key, "keys").distinct()
    longer = above.groupBy(key, F.col("prefix").alias("keys")).agg(F.max("at").alias("under"))
    kept = last.join(covered, [key, "keys"], "left_anti").join(longer, [key, "keys"], "left").where("under IS NULL OR under < at")
    return kept.select(key, F.array_join("keys", ".").alias("path"), "value")


def environment_over(settings: DataFrame, environment: DataFrame, names: Column) -> DataFrame:
    """Settings (key, path, value) with the value of an environment variable (name, setting) of the name that names gives."""
    return settings.join(environment, names == F.col("name"), "left").withColumn("value", F.coalesce("setting", "value")).drop("name", "setting")
