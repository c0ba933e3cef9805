"""The reference graph as a file of JSON lines beside an index: reused while it can be read and fits the indexed documents,
else built anew from these alone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EDGES = "src string, dst string, kind string, resolved boolean"


def fingerprint(indexed: DataFrame) -> str:
    """What (doc_id, content_sha256) of the indexed documents come to, in any order: sums of two hashes and a count."""
    keys = F.struct("doc_id", "content_sha256")
    whole = lambda h: F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0))
    row = indexed.agg(F.count("*"), whole(F.xxhash64(keys)), whole(F.xxhash64(F.lit(1), keys))).first()
    return f"{row[0]}:{row[1]}:{row[2]}"


def save_graph(edges: DataFrame, path: str, of: str) -> None:
    """Edges, and last of all the line that says which documents they are of: without it the file doesn't count."""
    edges.select("src", "dst", "kind", "resolved").write.mode("overwrite").json(f"{path}/edges")
    count = edges.sparkSession.read.schema(EDGES).json(f"{path}/edges").count()
    edges.sparkSession.createDataFrame([(of, count)], "of string, edges bigint").coalesce(1).write.mode("overwrite").json(f"{path}/head")


def load_graph(indexed: DataFrame, path: str) -> tuple[DataFrame | None, str]:
    """(edges, good), or none and why: absent, stale (other documents or contents) or corrupt (a line that can't be read,
    lines that are missing)."""
    spark = indexed.sparkSession
    try:
        head = spark.read.schema("of string, edges bigint").json(f"{path}/head").first()
        lines = spark.read.schema(f"{EDGES}, bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "bad").json(f"{path}/edges")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None, "absent"
    if head is None or head["of"] is None:
        return None, "corrupt"
    if head["of"] != fingerprint(indexed):
        return None, "stale"
    lost = F.col("bad").isNotNull() | F.col("src").isNull() | F.col("dst").isNull()
    found = lines.select("src", "dst", lost.alias("lost")).agg(F.count("*"), F.count_if("lost")).first()
    if found[1] or found[0] != head["edges"]:
        return None, "corrupt"
    return lines.drop("bad"), "good"


def cached_graph(indexed: DataFrame, path: str, build: Callable[[DataFrame], DataFrame], rebuild: bool = False) -> tuple[DataFrame, str]:
    """(edges, what was found): the stored graph where it is good, else that of build(indexed documents), stored."""
    edges, found = (None, "asked") if rebuild else load_graph(indexed, path)
    if edges is None:
        save_graph(build(indexed), path, fingerprint(indexed))
        edges = indexed.sparkSession.read.schema(EDGES).json(f"{path}/edges")
    return edges, found
