"""What the operators of this subpackage share: table access, shared storage and Arrow plumbing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; only where none is set (tests) a temporary one."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="quillmesh-"))
    return context.getCheckpointDir()


def shared_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Cuts lineage: writes df as Parquet in the shared folder and reads it again."""
    spark = df.sparkSession
    path = shared_path(spark, label)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remainder(column: str, modulus: int):
    """crc32 of an id written as text, modulo; null ids count as the empty string."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def map_rows(df: DataFrame, rows: Callable[[Iterator[tuple]], Iterable[tuple]], schema: str, flush: int = 2000) -> DataFrame:
    """mapInArrow for a generator over row tuples. Batches hold at most ``flush`` rows, so long texts stay bounded."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    spec = _parse_datatype_string(schema)
    target = to_arrow_schema(spec)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield from zip(*(column.to_pylist() for column in part.columns), strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for row in rows(read(batches)):
            held.append(row)
            size += sum(len(x) for x in row if isinstance(x, bytes | str | list))
            if len(held) >= flush or size > 8_000_000:
                yield _batch(held, target)
                held, size = [], 0
        if held:
            yield _batch(held, target)

    return df.mapInArrow(run, spec)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(column, field.type) for column, field in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def grouped_batches(rows: Iterator[tuple], most: int, text_at: int, most_chars: int) -> Iterator[list[tuple]]:
    """Lists of consecutive rows, cut by number or by length of text."""
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += len(row[text_at] or "")
        if len(held) >= most or size >= most_chars:
            yield held
            held, size = [], 0
    if held:
        yield held


def filter_rows(docs: DataFrame, judge: Callable[[Iterator[tuple]], Iterable[bool]], text_column: str = "text") -> DataFrame:
    """The rows of docs that judge keeps, with all their columns; judge gets (text,) rows and gives as many booleans."""
    at = docs.columns.index(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 2000):
                part = batch.slice(first, 2000)
                kept = pa.array(list(judge((text,) for text in part.column(at).to_pylist())), pa.bool_())
                yield part.filter(kept)

    return docs.mapInArrow(run, docs.schema)
