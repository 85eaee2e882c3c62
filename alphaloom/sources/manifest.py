"""What the files of a stored value table hold: scope, job, first and last date, rows.

A small table beside the data, one version after the other, says which files a replacement touches and answers the latest
date, so that neither reads the values. A version counts once it is complete; files that none lists are of a job that broke
off, and are not read by read_values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FIELDS = "file string, month string, factor_id string, factor_version int, params_hash string, entity_type string, job_id string, first_date date, last_date date, rows long"
#: Versions that stay when a new one is complete.
KEPT = 3


def _folder(spark: SparkSession, path: str):
    """The file system of a path, and the path as that system takes it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a file or folder, wherever Spark's file systems reach it."""
    fs, at = _folder(spark, path)
    fs.delete(at, True)


def versions(spark: SparkSession, path: str) -> list[int]:
    """Complete versions of the manifest, in order; they are few."""
    fs, at = _folder(spark, f"{path}/_manifest")
    if not fs.exists(at):
        return []
    new = spark._jvm.org.apache.hadoop.fs.Path
    return sorted(int(s.getPath().getName()[2:]) for s in fs.listStatus(at) if fs.exists(new(s.getPath(), "_SUCCESS")))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """FIELDS of every file of the table, a row for each scope and job in it."""
    have = versions(spark, path)
    return spark.read.schema(FIELDS).parquet(f"{path}/_manifest/v={have[-1]}") if have else spark.createDataFrame([], FIELDS)


def commit(spark: SparkSession, path: str, change: Callable[[DataFrame], DataFrame], tries: int = 5) -> None:
    """Writes change(manifest) as the next version. If another job takes that number first, it is tried on top of its version."""
    for left in reversed(range(tries)):
        have = versions(spark, path)
        try:
            change(manifest(spark, path)).coalesce(1).write.mode("errorifexists").parquet(f"{path}/_manifest/v={(have or [0])[-1] + 1}")
        except AnalysisException as e:
            if not left or "PATH_ALREADY_EXISTS" not in str(e):
                raise
            continue
        for old in have[: 1 - KEPT]:
            remove(spark, f"{path}/_manifest/v={old}")
        return


def files(df: DataFrame) -> set[str]:
    """The files behind a table as the manifest names them: month, factor, name."""
    return {"/".join(f.split("/")[-3:]) for f in df.inputFiles()}


def read_files(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    return spark.read.option("basePath", path).parquet(*[f"{path}/{n}" for n in sorted(names)])


def described(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """FIELDS of files of the table, from their scope and date columns."""
    own = F.regexp_extract("_metadata.file_path", "([^/]*/[^/]*/[^/]*)$", 1)
    rows = read_files(spark, path, names).select(own.alias("file"), F.col("month").cast("string").alias("month"), "factor_id", "factor_version", "params_hash", "entity_type", "job_id", "trade_date")
    s = rows.groupBy("file", "month", "factor_id", "factor_version", "params_hash", "entity_type", "job_id")
    return s.agg(F.min("trade_date").alias("first_date"), F.max("trade_date").alias("last_date"), F.count("*").alias("rows"))


def unlisted(spark: SparkSession, path: str, partitions: list[tuple[str, str]]) -> list[str]:
    """Files of the partitions (month, factor) that the manifest does not list."""
    if not partitions:
        return []
    folders = [f"{path}/month={m}/factor_id={f}" for m, f in partitions]
    known = {r["file"] for r in manifest(spark, path).where(F.col("month").isin([m for m, _ in partitions])).select("file").distinct().collect()}
    return sorted(files(spark.read.option("basePath", path).parquet(*folders)) - known)


def read_values(spark: SparkSession, path: str) -> DataFrame:
    """The table as its latest version lists it."""
    return read_files(spark, path, [r["file"] for r in manifest(spark, path).select("file").distinct().collect()])


def latest_dates(spark: SparkSession, path: str) -> DataFrame:
    """(factor_id, factor_version, params_hash, entity_type, rows, first_date, last_date), without reading values."""
    s = manifest(spark, path).groupBy("factor_id", "factor_version", "params_hash", "entity_type")
    return s.agg(F.sum("rows").alias("rows"), F.min("first_date").alias("first_date"), F.max("last_date").alias("last_date"))
