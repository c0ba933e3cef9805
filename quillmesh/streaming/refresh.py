"""Incremental refresh of a store from a raw archive: a file stream that takes what is new, one version of the store a batch.

Offsets are kept in the checkpoint folder and each batch is published with its number, so a run may end at any point,
by a crash or when it is asked to, and the next one goes on: a batch whose rows were published but whose offset was not
is passed over. The result equals one batch over the whole archive. Two runs over one checkpoint folder are refused by
Spark. What was done to each document is written in ``reports``, one folder a batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmesh.sources.archive import RAW_SCHEMA, fetch_states
from quillmesh.sources.store import VersionedTable

OUTCOME = "doc_id string, state string, batch bigint"
POLL_SECONDS = 0.2


class Refresh:
    """parse: raw records (RAW_SCHEMA) to rows of the store, which has doc_id as its key and a column content_sha256; a
    document that can't be parsed comes back with an ``error`` and is reported, not stored."""

    def __init__(self, spark: SparkSession, archive: str, store: VersionedTable, parse: Callable[[DataFrame], DataFrame], folder: str, files_per_batch: int = 1000):
        self.spark, self.archive, self.store, self.parse, self.folder, self.files_per_batch = spark, archive, store, parse, folder, files_per_batch

    def _apply(self, batch: DataFrame, number: int) -> None:
        note = f"{self.folder} {number}"
        if self.store.pointer.noted(note):
            return
        newest = Window.partitionBy("doc_id").orderBy(F.col("fetched_at").desc(), F.col("content_sha256"))
        last = batch.withColumn("__n", F.row_number().over(newest)).where("__n = 1").drop("__n")
        seen = fetch_states(last, self.store.read().select("doc_id", "content_sha256"))
        parsed = self.parse(seen.where("state <> 'unchanged'").drop("state")).persist()
        failed = parsed.where("error IS NOT NULL").select("doc_id", F.lit("error").alias("failed"))
        outcomes = seen.select("doc_id", "state").join(failed, "doc_id", "left").select("doc_id", F.coalesce("failed", "state").alias("state"))
        outcomes.write.mode("overwrite").parquet(f"{self.folder}/reports/batch={number}")
        self.store.upsert(parsed.where("error IS NULL"), note)
        parsed.unpersist()

    def run(self, stop: Callable[[], bool] = lambda: False) -> str:
        """Takes in all files that are new, in batches, until there are none or stop() says so: completed or cancelled."""
        stream = self.spark.readStream.schema(RAW_SCHEMA).option("maxFilesPerTrigger", self.files_per_batch).parquet(self.archive)
        query = stream.writeStream.foreachBatch(self._apply).option("checkpointLocation", f"{self.folder}/offsets").trigger(availableNow=True).start()
        while not query.awaitTermination(POLL_SECONDS):
            if stop():
                query.stop()
                return "cancelled"
        return "completed"

    def report(self) -> DataFrame:
        """(doc_id, state, batch): new, changed, unchanged or error."""
        try:
            return self.spark.read.schema(OUTCOME).parquet(f"{self.folder}/reports")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], OUTCOME)

    def counts(self) -> dict[str, int]:
        found = {r.state: r["count"] for r in self.report().groupBy("state").count().collect()}
        return {state: found.get(state, 0) for state in ("new", "changed", "unchanged", "error")}
