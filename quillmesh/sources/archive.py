"""Sources and sinks: raw archives, line files with comments, catalogues, chunk stores and training sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmesh.functions import text as T

LEAST_DELAY = 20.0
RAW_SCHEMA = "source string, doc_id string, url string, fetched_at timestamp, content_sha256 string, http_status int, content_type string, content string"


def stem(path: Column) -> Column:
    """A file's name without folder and ending; ``neg5`` stands for ``-5``."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1), "^neg(?=\\d)", "-")


def read_archive(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, content, sha256) of each HTML file in a folder and those below, with its metadata file where there is one."""
    pages = spark.read.format("binaryFile").option("pathGlobFilter", "*.html").option("recursiveFileLookup", "true").load(folder)
    return pages.select(stem(F.col("path")).alias("doc_id"), F.decode("content", "UTF-8").alias("content"), F.sha2("content", 256).alias("content_sha256"))


def read_metadata(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    read = spark.read.schema(schema).option("multiLine", "true").option("pathGlobFilter", "*.json").option("recursiveFileLookup", "true").json(folder)
    return read.withColumn("doc_id", stem(F.input_file_name()))


def write_archive(raw: DataFrame, folder: str) -> None:
    """Appends raw records, by source."""
    raw.write.mode("append").partitionBy("source").parquet(folder)


def read_lines(spark: SparkSession, path: str, schema: str, comments: bool = True) -> DataFrame:
    """Rows of a JSON line file; blank lines are skipped and, if asked, those that begin with ``//``."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    if comments:
        lines = lines.where(~F.ltrim("value").startswith("//"))
    return lines.select(F.from_json("value", schema).alias("r")).select("r.*")


def last_rows(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key, and how many it replaced."""
    w = Window.partitionBy(key)
    return df.withColumn("__n", F.row_number().over(w.orderBy(F.desc(order)))).withColumn("replaced", F.count("*").over(w) - 1).where("__n = 1").drop("__n")


def fetch_states(fetched: DataFrame, known: DataFrame, key: str = "doc_id", digest: str = "content_sha256") -> DataFrame:
    """fetched with state new, changed or unchanged."""
    before = known.select(key, F.col(digest).alias("__before"))
    return fetched.join(before, key, "left").withColumn("state", F.when(F.col("__before").isNull(), "new").when(F.col("__before") != F.col(digest), "changed").otherwise("unchanged")).drop("__before")


def crawl_delay(robots: Column) -> Column:
    return F.greatest(F.coalesce(F.regexp_extract(robots, r"(?i)crawl-delay:\s*(\d+(?:\.\d+)?)", 1).try_cast("double"), F.lit(LEAST_DELAY)), F.lit(LEAST_DELAY))


def result_links(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, pos, target, title) of links with a title of six characters and more, each target once a page."""
    p = r'(?is)<a\s[^>]*href="([^"]*)"[^>]*>(.*?)</a>'
    zipped = F.arrays_zip(F.regexp_extract_all(html, F.lit(p), F.lit(1)).alias("target"), F.regexp_extract_all(html, F.lit(p), F.lit(2)).alias("title"))
    spread = pages.select(key, F.posexplode(zipped).alias("pos", "l")).select(key, "pos", "l.target", T.strip(F.regexp_replace("l.title", r"<[^>]*>", "")).alias("title"))
    first = F.row_number().over(Window.partitionBy(key, "target").orderBy("pos"))
    return spread.where(F.length("title") >= 6).withColumn("__n", first).where("__n = 1").drop("__n")


def total_hits(html: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(html, r"(?i)(?:topildi|найдено|found)\D{0,20}(\d[\d\s ]*)", 1), r"(?U)\s", "").try_cast("int")


def query_plan(dimensions: list[DataFrame], vocabulary: DataFrame) -> DataFrame:
    """Every combination of small dimensions, with the words of its language."""
    plan = dimensions[0]
    for dimension in dimensions[1:]:
        plan = plan.crossJoin(F.broadcast(dimension))
    return plan.join(F.broadcast(vocabulary), "lang")


def file_name_parts(name: Column) -> list[Column]:
    """``Name__url__YYYY-MM-DD`` in three; a part that looks like a date is the version."""
    parts = F.split(name, "__", -1)
    date = F.get(F.filter(parts, lambda x: x.rlike(r"^\d{4}-\d{2}-\d{2}$")), F.lit(0))
    rest = F.filter(parts, lambda x: ~x.rlike(r"^\d{4}-\d{2}-\d{2}$"))
    return [F.get(rest, F.lit(0)).alias("document"), F.get(rest, F.lit(1)).alias("url"), date.alias("version")]


def extracted_text(content: Column, kind: Column) -> Column:
    """Text of plain, Markdown and HTML files: words broken at line ends joined, blank runs shortened."""
    plain = F.when(kind == "html", T.clean_html(content)).otherwise(content)
    joined = F.regexp_replace(F.regexp_replace(plain, r"\r\n?", "\n"), r"(?U)(\p{L})-\n(\p{L})", "$1$2")
    return T.strip(F.regexp_replace(F.regexp_replace(joined, r"[ \t]+", " "), r"\n{3,}", "\n\n"))


def write_index(tokens: DataFrame, folder: str, key: str = "doc_id") -> None:
    """The inverted index as tables; a repeated id is refused."""
    from quillmesh.operators.retrieval import build_index

    if not tokens.groupBy(key).count().where("count > 1").isEmpty():
        raise ValueError(f"{key} is not unique")
    postings, lengths, terms = build_index(tokens, key)
    postings.sortWithinPartitions("term").write.mode("overwrite").parquet(f"{folder}/postings")
    lengths.write.mode("overwrite").parquet(f"{folder}/lengths")
    terms.write.mode("overwrite").parquet(f"{folder}/terms")


def append_log(rows: DataFrame, folder: str) -> bool:
    """Appends to a log; what fails is told by the result alone, as a log must not stop what it is of."""
    try:
        rows.write.mode("append").parquet(folder)
    except Exception:  # noqa: BLE001
        return False
    return True


def upsert(store: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """store with fresh rows in place of those of the same key."""
    return store.join(fresh.select(key), key, "left_anti").unionByName(fresh)


def split_training(samples: DataFrame, order: list[str], share: float = 0.05) -> DataFrame:
    """samples with part: validation for the first 5 % in order, one at least, else train.

    The cut is a quantile found by counting keys, so the samples aren't ordered in one task.
    """
    total = samples.count()
    size = max(1, int(total * share)) if total else 0
    keys = samples.select(*order).orderBy(*order).limit(size)
    return samples.join(keys.distinct().withColumn("__v", F.lit(True)), order, "left").withColumn("part", F.when(F.col("__v"), "validation").otherwise("train")).drop("__v")


def to_json_lines(df: DataFrame) -> DataFrame:
    """One JSON text a row, empty fields left out."""
    filled = [F.nullif(c, F.lit("")).alias(c) if kind == "string" else F.col(c) for c, kind in df.dtypes]
    return df.select(F.to_json(F.struct(*filled), {"ignoreNullFields": "true"}).alias("value"))
