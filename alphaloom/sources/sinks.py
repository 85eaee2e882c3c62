"""Sinks: factor values, predictions, snapshots, results by key. Parquet, partitioned so that a replacement touches few files."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import signal_close
from . import manifest as manifests


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one that spark.checkpoint.dir names; a temporary one only where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or tempfile.mkdtemp(prefix="alphaloom-")
    return f"{base.rstrip('/')}/tables/{uuid.uuid4().hex}/{name}"


def stored(df: DataFrame) -> DataFrame:
    """df written to the shared scratch folder and read back: evaluated once, whatever reads it, and safe from lost executors."""
    path = scratch(df.sparkSession, "stored")
    df.write.parquet(path)
    return df.sparkSession.read.schema(nullable(df.schema)).parquet(path)


def nullable(schema: T.StructType) -> T.StructType:
    """The schema as Parquet gives it back."""
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields])


def value_rows(values: DataFrame, factor_id: str, version: int, params_hash: str, job_id: str, vintage: str, entity_type: str = "stock") -> DataFrame:
    """Values with identity, event time (15:00 of the date), write time, vintage and the month they are stored under."""
    return values.withColumns({
        "factor_id": F.lit(factor_id), "factor_version": F.lit(version), "params_hash": F.lit(params_hash), "entity_type": F.lit(entity_type), "job_id": F.lit(job_id), "source_vintage": F.lit(vintage),
        "event_available_at": signal_close(F.col("trade_date")), "available_at": F.current_timestamp(), "computed_at": F.current_timestamp(), "updated_at": F.current_timestamp(), "month": F.date_format("trade_date", "yyyy-MM"),
    })


def write_values(rows: DataFrame, path: str) -> None:
    """Appends, by month and factor, sorted by entity and date within files, and lists the new files in the manifest.

    What a job of the same id that broke off left unlisted in these partitions is deleted first.
    """
    spark, ready = rows.sparkSession, stored(rows)
    partitions = [(r["month"], r["factor_id"]) for r in ready.select("month", "factor_id").distinct().collect()]  # months of one job
    ready.sortWithinPartitions("entity_code", "trade_date").write.mode("append").partitionBy("month", "factor_id").parquet(path)
    _list(spark, path, partitions, [r["job_id"] for r in ready.select("job_id").distinct().collect()], [])


def _list(spark: SparkSession, path: str, partitions: list[tuple[str, str]], jobs: list[str], gone: list[str]) -> None:
    """Adds the unlisted files of the partitions that are of these jobs to the manifest, and takes others out."""
    new = manifests.unlisted(spark, path, partitions)
    if not new and not gone:
        return
    known = manifests.FIELDS
    added = stored(manifests.described(spark, path, new).where(F.col("job_id").isin(jobs))) if new else spark.createDataFrame([], known)
    manifests.commit(spark, path, lambda m: m.where(~F.col("file").isin(gone) if gone else F.lit(True)).unionByName(added))


SCOPE = ("factor_id", "factor_version", "params_hash", "entity_type")


def supersede(spark: SparkSession, path: str, job_id: str, start: str | None = None, end: str | None = None) -> dict[str, int]:
    """Drops rows that the job replaces: same scope, within the job's range of dates, of another job.

    The range is [start, end] where given, else that of the job's rows; dates on which the new job has no rows lose their
    old ones too. The manifest says which files hold such rows: those that hold nothing else are dropped unread, the others are
    rewritten without them, all that is read. Returns how many files were rewritten and dropped. The new files count from the
    moment the manifest lists them; the old ones are deleted after that. Done again after a break, it ends in the same state.
    """
    m = manifests.manifest(spark, path)
    lo, hi = (F.lit(start).cast("date") if start else F.min("first_date")), (F.lit(end).cast("date") if end else F.max("last_date"))
    mine = stored(m.where(F.col("job_id") == job_id).groupBy(*SCOPE).agg(lo.alias("a"), hi.alias("b")))
    met = m.join(mine, list(SCOPE), "left").withColumns({
        "meets": F.coalesce((F.col("job_id") != job_id) & (F.col("last_date") >= F.col("a")) & (F.col("first_date") <= F.col("b")), F.lit(False)),
        "within": F.coalesce((F.col("job_id") != job_id) & (F.col("first_date") >= F.col("a")) & (F.col("last_date") <= F.col("b")), F.lit(False)),
    })
    touched = met.groupBy("file", "month", "factor_id").agg(F.max("meets").alias("meets"), F.min("within").alias("whole"), F.collect_set("job_id").alias("jobs")).where("meets").collect()  # files of the range
    partly = [r for r in touched if not r["whole"]]
    if partly:
        rows = manifests.read_files(spark, path, [r["file"] for r in partly])
        goes = (F.col("job_id") != job_id) & F.coalesce(F.col("trade_date").between(F.col("a"), F.col("b")), F.lit(False))
        kept = stored(rows.join(mine, list(SCOPE), "left").where(~goes).select(*rows.columns))
        kept.withColumn("month", F.date_format("trade_date", "yyyy-MM")).sortWithinPartitions("entity_code", "trade_date").write.mode("append").partitionBy("month", "factor_id").parquet(path)
    if touched:
        jobs = sorted({j for r in partly for j in r["jobs"]})
        _list(spark, path, sorted({(r["month"], r["factor_id"]) for r in partly}), jobs, [r["file"] for r in touched])
    for r in touched:
        manifests.remove(spark, f"{path}/{r['file']}")
    return {"rewritten": len(partly), "dropped": len(touched) - len(partly)}


REQUIRED = ("entity_code", "trade_date", "model_id", "model_version", "raw_prediction", "score")


def check_predictions(df: DataFrame) -> DataFrame:
    """df, if it has the columns and rows that predictions need, each entity once a date, scores within -1 and 1."""
    if missing := [c for c in REQUIRED if c not in df.columns]:
        raise ValueError(f"predictions lack {missing}")
    if not df.take(1):
        raise ValueError("there are no predictions")
    if twice := df.groupBy("model_id", "model_version", "trade_date", "entity_code").count().where("count > 1").take(1):
        raise ValueError(f"repeated prediction: {tuple(twice[0])}")
    if df.where("score < -1 or score > 1").take(1):
        raise ValueError("scores must be within -1 and 1")
    return df


def write_predictions(df: DataFrame, path: str, kind: str = "training") -> int:
    """Replaces a model version, or for inference only its dates; returns the rows read back."""
    spark, ready = df.sparkSession, check_predictions(stored(df))  # what is checked is what is written
    keys = ["model_id", "model_version"] if kind == "training" else ["model_id", "model_version", "trade_date"]
    ready.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(f"{path}/{kind}")
    back = spark.read.parquet(f"{path}/{kind}").join(ready.select(*keys).distinct(), keys, "left_semi").count()
    if back != ready.count():
        raise RuntimeError(f"{back} rows were stored")
    return back


def append_predictions(df: DataFrame, path: str) -> None:
    check_predictions(stored(df)).write.mode("append").partitionBy("model_id", "model_version").parquet(path)


def fingerprint(df: DataFrame) -> str:
    """Of the rows, whatever their order: their count and the sum of their hashes."""
    r = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias("h")).first()
    return f"{r['n']}-{r['h'] or 0}"


def fingerprints(df: DataFrame, parts: Column) -> DataFrame:
    """(part, rows, hash) of each part of a table, whatever the order of its rows."""
    s = df.withColumn("__part", F.coalesce(parts.cast("string"), F.lit("")))
    return s.groupBy(F.col("__part").alias("part")).agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")), F.lit(0)).cast("string").alias("hash"))


def root(leaves: DataFrame) -> DataFrame:
    """leaves (copy, part, rows, hash) -> one row: parts, rows, and the hash of their hashes."""
    one = F.concat_ws(":", "copy", "part", F.col("rows").cast("string"), "hash")
    return leaves.agg(F.count("*").alias("parts"), F.sum("rows").alias("rows"), F.sha2(F.array_join(F.array_sort(F.collect_list(one)), "\n"), 256).alias("hash"))  # a row per part


def _leaves(copies: dict[str, DataFrame], parts: Column) -> DataFrame:
    return reduce(DataFrame.unionByName, [fingerprints(df, parts).withColumn("copy", F.lit(name)) for name, df in copies.items()])


def snapshot(df: DataFrame, name: str, path: str) -> DataFrame:
    """One table, written once under its name; see snapshot_of."""
    return snapshot_of({"rows": df}, name, path)["rows"]


def snapshot_of(copies: dict[str, DataFrame], name: str, path: str, parts: Column | None = None) -> dict[str, DataFrame]:
    """Tables (as raw and imputed rows of one dataset) written once under one name, and read back.

    The hashes of each copy's parts (by default all of it) and the hash of these are stored with it, and are compared whenever
    it is read: parts that were changed, lost or added are named in the error. Fingerprints are stored last: rows without any
    are of a job that broke off, and are written anew.
    """
    spark, at, parts = next(iter(copies.values())).sparkSession, f"{path}/{name}", F.lit("all") if parts is None else parts
    read = lambda: {c: spark.read.parquet(f"{at}/{c}") for c in copies}
    try:
        kept = spark.read.parquet(f"{at}/_fingerprints")
        top = spark.read.parquet(f"{at}/_root").first()
    except AnalysisException as e:  # not written yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        for copy, df in copies.items():
            df.write.mode("overwrite").parquet(f"{at}/{copy}")
        _leaves(read(), parts).coalesce(1).write.mode("overwrite").parquet(f"{at}/_fingerprints")
        kept = spark.read.parquet(f"{at}/_fingerprints")
        root(kept).coalesce(1).write.mode("overwrite").parquet(f"{at}/_root")
        return read()
    if root(kept).first() != top:
        raise RuntimeError(f"the fingerprints of snapshot {name} were changed")
    out = read()
    now = _leaves(out, parts)
    if changed := now.select(*kept.columns).exceptAll(kept).unionByName(kept.exceptAll(now.select(*kept.columns))).select("copy", "part").distinct().orderBy("copy", "part").take(20):
        raise RuntimeError(f"snapshot {name} was changed: {', '.join(f'{r['copy']}/{r['part']}' for r in changed)}")
    return out


def snapshot_root(spark: SparkSession, name: str, path: str) -> str:
    """The hash that stands for a snapshot."""
    return spark.read.parquet(f"{path}/{name}/_root").first()["hash"]


def replace_by_key(df: DataFrame, path: str, key: str) -> None:
    """All rows of the keys in df are replaced by df's; other keys stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)
