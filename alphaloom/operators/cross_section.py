"""Post-processing of one day's cross-section: clipping, ranking, standardising.

Each operator is a window over the day, whose rows are one per entity: small, even groups. Exact percentiles are taken
by a grouped aggregation and joined back, as window percentiles are evaluated row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY = "trade_date"
#: Parts into which rows are dealt before they are sorted, so that a task holds few of them whatever the caller's partitions are.
DEALT = 200


def xs(day: str = DAY) -> Window:
    return Window.partitionBy(day)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """The rows in DEALT parts, those of equal keys in one."""
    return df.repartition(DEALT, *keys) if keys else df


def finite(df: DataFrame, value: str = "raw_value") -> DataFrame:
    """Rows whose value is neither null nor NaN nor infinite."""
    v = F.col(value)
    return df.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))


def clip(x: Column, low: Column, high: Column) -> Column:
    return F.least(F.greatest(x, low), high)


def _with_percentiles(df: DataFrame, value: str, points: dict[str, float], day: str) -> DataFrame:
    at = df.groupBy(day).agg(*[F.percentile(value, F.lit(q)).alias(name) for name, q in points.items()])
    return df.join(at, day, "left")


def winsorize_quantile(df: DataFrame, lo: float = 0.01, hi: float = 0.99, value: str = "raw_value", out: str = "processed", day: str = DAY) -> DataFrame:
    """Adds out: the value clipped to the day's exact quantiles."""
    edged = _with_percentiles(df, value, {"__lo": lo, "__hi": hi}, day)
    return edged.withColumn(out, clip(F.col(value), F.col("__lo"), F.col("__hi"))).drop("__lo", "__hi")


def winsorize_mad(df: DataFrame, width: float = 3.0, value: str = "raw_value", out: str = "processed", day: str = DAY) -> DataFrame:
    """Adds out: the value clipped to median +- width * 1.4826 * median absolute deviation; as it is where that is 0."""
    centred = _with_percentiles(df, value, {"__m": 0.5}, day).withColumn("__d", F.abs(F.col(value) - F.col("__m")))
    spread = _with_percentiles(centred, "__d", {"__s": 0.5}, day)
    reach = width * 1.4826 * F.col("__s")
    clipped = F.when(F.col("__s") > 0, clip(F.col(value), F.col("__m") - reach, F.col("__m") + reach)).otherwise(F.col(value))
    return spread.withColumn(out, clipped).drop("__m", "__d", "__s")


def winsorize_median(df: DataFrame, value: str = "raw_value", out: str = "processed", day: str = DAY) -> DataFrame:
    return winsorize_mad(df, 5.0, value, out, day)


def rank_desc(value: str, day: str = DAY) -> Column:
    """1 for the largest, ties share."""
    return F.rank().over(xs(day).orderBy(F.col(value).desc()))


def pct_rank(value: str, day: str = DAY) -> Column:
    return F.percent_rank().over(xs(day).orderBy(F.col(value)))


def zscore(value: str, day: str = DAY) -> Column:
    """Population deviation; 0 where it is 0."""
    s = F.stddev_pop(value).over(xs(day))
    return F.when(s > 0, (F.col(value) - F.avg(value).over(xs(day))) / s).otherwise(0.0)


def score(mode: str, value: str = "processed", day: str = DAY) -> Column:
    """mode: zscore, rank (the percentile) or none (the value)."""
    return {"zscore": zscore(value, day), "rank": pct_rank(value, day), "none": F.col(value)}[mode]


def score_boolean(value: str = "raw_value") -> Column:
    return F.when(F.col(value) != 0, 1.0).otherwise(0.0)


def equal_count_bucket(value: str, k: int, entity: str = "entity_code", day: str = DAY) -> Column:
    """1..k in ascending order; of equal values the larger entity comes first."""
    place = F.row_number().over(xs(day).orderBy(F.col(value), F.col(entity).desc())) - 1
    return (F.floor(place * k / F.count(F.lit(1)).over(xs(day))) + 1).cast("int")


def mean_rank(value: str, keys: list[str]) -> Column:
    """Ascending from 1 among rows of equal keys, ties get their mean rank: midway between the first and the last place.

    Both places come from one sort, the last one as the count of all rows up to the value.
    """
    w = Window.partitionBy(*keys).orderBy(value)
    return (F.rank().over(w) + F.count(F.lit(1)).over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow))) / 2


def avg_rank(value: str, day: str = DAY) -> Column:
    """Ascending from 1 within the day, ties get their mean rank."""
    return mean_rank(value, [day])


def avg_pct_rank(value: str, day: str = DAY) -> Column:
    return avg_rank(value, day) / F.count(F.lit(1)).over(xs(day))


def rank_first(value: str, entity: str = "entity_code", day: str = DAY) -> Column:
    """1 for the largest, ties by entity."""
    return F.row_number().over(xs(day).orderBy(F.col(value).desc(), F.col(entity)))


def rank_score(value: str, scope: str = "stock", entity: str = "entity_code", day: str = DAY) -> Column:
    """-1 to 1: by average percentile for stocks, by unique rank for groups; 0 for a lone row of a group scope."""
    if scope == "stock":
        return 2 * avg_pct_rank(value, day) - 1
    n = F.count(F.lit(1)).over(xs(day))
    return F.when(n > 1, 1 - 2 * (rank_first(value, entity, day) - 1) / (n - 1)).otherwise(0.0)
