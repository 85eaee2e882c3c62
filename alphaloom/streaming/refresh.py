"""Refresh of new dates: one function for a batch job and for foreachBatch of a stream of panel rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.factor_job import compute_factor
from ..sources.manifest import manifest
from ..sources.sinks import supersede, value_rows, write_values


def incremental_refresh(spark: SparkSession, panel: DataFrame, make: Callable[[DataFrame], DataFrame], window: int, path: str, factor_id: str, job_id: str, start: str, end: str) -> dict[str, int]:
    """Computes a factor's dates [start, end] with look-back, appends them and drops what older jobs wrote for them.

    A job whose rows are listed already is not written again, so a job that broke off half way can be repeated. Late rows of a
    date come with a later job and a later write time; readers choose what was known when. Returns what supersede does.
    """
    if not manifest(spark, path).where(F.col("job_id") == job_id).take(1):
        values = compute_factor(panel, make, start, end, window)
        write_values(value_rows(values, factor_id, 1, "", job_id, end), path)
    return supersede(spark, path, job_id, start, end)


LEDGER = "stream string, batch long, first_date date, last_date date"


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """The batches that are done, by stream: LEDGER."""
    try:
        return spark.read.schema(LEDGER).parquet(f"{path}/_ledger")
    except AnalysisException as e:  # none yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], LEDGER)


def refresh_batch(panel_of: Callable[[SparkSession], DataFrame], make: Callable[[DataFrame], DataFrame], window: int, path: str, factor_id: str, stream: str | None = None) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: the dates of the batch are computed anew over the whole panel, once for each batch.

    A batch is known by its stream and number. stream is by default the id that Spark keeps with the checkpoint, so a stream
    whose checkpoint was reset numbers its batches apart from those before. What is in the ledger is done: a batch that comes
    again is passed over; one that broke off goes on where its files or the ledger lack it.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        own = stream or spark.sparkContext.getLocalProperty("sql.streaming.queryId")
        if ledger(spark, path).where((F.col("stream") == own) & (F.col("batch") == number)).take(1):
            return
        span = batch.agg(F.min("trade_date").alias("a"), F.max("trade_date").alias("b")).first()
        if span["a"] is not None:
            incremental_refresh(spark, panel_of(spark), make, window, path, factor_id, f"{own}-{number}", str(span["a"]), str(span["b"]))
        spark.createDataFrame([(own, number, span["a"], span["b"])], LEDGER).coalesce(1).write.mode("append").parquet(f"{path}/_ledger")

    return run
