"""Reading stored values and definitions, and what state they are in."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import latest_by

#: What values may be sorted by.
SORTABLE = ("trade_date", "entity_code", "factor_id", "value", "raw_value", "rank_value", "percentile", "score", "computed_at", "updated_at")


def _filtered(df: DataFrame, filters: dict) -> DataFrame:
    """Equality on columns, lists as membership, start and end on trade_date, known_at on available_at, event_at on event_available_at."""
    for key, value in filters.items():
        if key in ("start", "end"):
            edge = F.lit(value).cast("date")
            df = df.where(F.col("trade_date") >= edge if key == "start" else F.col("trade_date") <= edge)
        elif key in ("known_at", "event_at"):
            at = F.col("available_at" if key == "known_at" else "event_available_at")
            df = df.where(at <= F.lit(value).cast("timestamp"))
        elif isinstance(value, (list, tuple)):
            df = df.where(F.col(key).isin(*value))
        else:
            df = df.where(F.col(key) == value)
    return df


def _latest_version(df: DataFrame) -> DataFrame:
    top = df.groupBy("factor_id").agg(F.max("factor_version").alias("factor_version"))
    return df.join(top, ["factor_id", "factor_version"], "left_semi")


def list_values(df: DataFrame, filters: dict, order: list[tuple[str, str]], limit: int, offset: int = 0) -> DataFrame:
    """A page of values; without a factor_version the latest of each factor."""
    if wrong := [c for c, _ in order if c not in SORTABLE]:
        raise ValueError(f"cannot sort by {wrong}")
    base = df if "factor_version" in filters else _latest_version(df)
    by = [F.col(c).desc() if way == "desc" else F.col(c).asc() for c, way in order]
    return _filtered(base, filters).orderBy(*by).offset(offset).limit(limit)


def count_values(df: DataFrame, filters: dict) -> DataFrame:
    return _filtered(df, filters).agg(F.count("*").alias("n"), F.max("trade_date").alias("latest_date"))


def latest_date(df: DataFrame, filters: dict) -> DataFrame:
    return _filtered(df, filters).agg(F.max("trade_date").alias("latest_date"))


def _coverage() -> list[Column]:
    return [F.count("*").alias("rows"), F.count_distinct("entity_code").alias("entities"), F.count_distinct("trade_date").alias("dates"), F.min("trade_date").alias("first_date"), F.max("trade_date").alias("last_date")]


def coverage(df: DataFrame, filters: dict) -> DataFrame:
    return _filtered(df, filters).agg(*_coverage())


def sync_states(df: DataFrame, keys: list[str]) -> DataFrame:
    """coverage of every key in one aggregation."""
    return df.groupBy(*keys).agg(*_coverage())


def quality(df: DataFrame, metrics: list[str], filters: dict | None = None) -> DataFrame:
    """A row per metric: counts, ratios, moments and a status, from one aggregation."""
    rows = _filtered(df, filters or {})
    each = []
    for m in metrics:
        x = F.col(m)
        each.append(F.struct(F.lit(m).alias("metric"), F.count("*").alias("rows"), F.count(F.when(x.isNull(), 1)).alias("nulls"), F.count(F.when(x == 0, 1)).alias("zeros"), F.min(x).alias("min"), F.max(x).alias("max"), F.avg(x).alias("avg"), F.stddev_pop(x).alias("std")))
    long = rows.agg(F.array(*each).alias("m")).select(F.explode("m").alias("m")).select("m.*")
    status = F.when(F.col("rows") == 0, "empty").when(F.col("nulls") == F.col("rows"), "not_generated").when(F.col("nulls") > 0, "partial").otherwise("generated")
    return long.withColumns({"null_ratio": F.try_divide("nulls", "rows"), "zero_ratio": F.try_divide("zeros", "rows"), "status": status})


def cross_check(a: DataFrame, b: DataFrame, on: list[str], value: str, tolerance: float = 1e-9) -> DataFrame:
    """(left_rows, right_rows, joined, mismatches, max_diff) of two computations of one value."""
    met = a.select(*on, F.col(value).alias("__a")).join(b.select(*on, F.col(value).alias("__b")), on, "full_outer")
    gap = F.abs(F.col("__a") - F.col("__b"))
    return met.agg(F.count("__a").alias("left_rows"), F.count("__b").alias("right_rows"), F.count(gap).alias("joined"), F.count(F.when(gap > tolerance, 1)).alias("mismatches"), F.max(gap).alias("max_diff"))


def read_result(df: DataFrame, filters: dict, keys: list[str], order: list[str], limit: int) -> DataFrame:
    """The last version of each key of one job, in order, capped."""
    return latest_by(_filtered(df, filters), keys, ["updated_at", "computed_at"]).orderBy(*order).limit(limit)


def latest_runs(runs: DataFrame) -> DataFrame:
    """The last successful full run per model and version; research runs do not count."""
    good = runs.where("status = 'success' and profile = 'full' and not research_only")
    return latest_by(good, ["model_id", "model_version"], ["finished_at", "run_id"])


def latest_definitions(df: DataFrame) -> DataFrame:
    return latest_by(df, ["factor_id"], ["version", "updated_at", "seq"])


def definitions_per_version(df: DataFrame) -> DataFrame:
    return latest_by(df, ["factor_id", "version"], ["updated_at", "seq"])


def versions(df: DataFrame) -> DataFrame:
    return df.groupBy("factor_id").agg(F.sort_array(F.collect_set("version"), False).alias("versions"))


def resolve(definitions: DataFrame, requests: DataFrame) -> DataFrame:
    """requests (factor_id, requested) -> the definition of that version, of the latest where requested is null."""
    one = definitions_per_version(definitions)
    top = one.groupBy("factor_id").agg(F.max("version").alias("__top"))
    wanted = requests.join(top, "factor_id").withColumn("version", F.coalesce("requested", "__top")).drop("__top")
    return wanted.join(one, ["factor_id", "version"])


def definitions_by_update(df: DataFrame) -> DataFrame:
    at = F.struct("updated_at", "seq")
    return df.groupBy("factor_id").agg(F.max_by("expression", at).alias("expression"), F.max_by("version", at).alias("version"))


def definition_changes(existing: DataFrame, new: DataFrame) -> DataFrame:
    """new with change: create (new factor or newer version), unchanged, updated (latest version), else conflict."""
    top = existing.groupBy("factor_id").agg(F.max("version").alias("__top"))
    old = existing.select("factor_id", "version", F.col("expression").alias("__old"), F.lit(1).alias("__here"))
    met = new.join(top, "factor_id", "left").join(old, ["factor_id", "version"], "left")
    change = (
        F.when(F.col("__top").isNull() | (F.col("__here").isNull() & (F.col("version") > F.col("__top"))), "create")
        .when(F.col("__here").isNull(), "conflict")
        .when(F.col("__old").eqNullSafe(F.col("expression")), "unchanged")
        .when(F.col("version") == F.col("__top"), "updated")
        .otherwise("conflict")
    )
    return met.withColumn("change", change).select(*new.columns, "change")


def upsert_definition(existing: DataFrame, new: DataFrame) -> DataFrame:
    """existing with created definitions appended and updated ones replaced; conflicts are an error."""
    marked = definition_changes(existing, new)
    if clash := marked.where("change = 'conflict'").select("factor_id", "version").take(3):
        raise ValueError(f"conflicting definitions: {[tuple(r) for r in clash]}")
    added = marked.where("change in ('create', 'updated')").drop("change")
    kept = existing.join(added.select("factor_id", "version"), ["factor_id", "version"], "left_anti")
    return reduce(DataFrame.unionByName, [kept, added.select(*existing.columns)])
