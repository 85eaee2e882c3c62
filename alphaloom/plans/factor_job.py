"""Whole jobs: from a panel to stored factor values."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import catalog
from ..functions import rolling as r
from ..operators import cross_section as x
from ..sources.sinks import stored


def with_lookback(panel: DataFrame, start: str, end: str, n: int, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """make over [start - look-back, end], then only [start, end]: the range filter stays above the windows."""
    back = F.date_sub(F.lit(start).cast("date"), max(4 * n + 20, 90))
    read = panel.where((F.col("trade_date") >= back) & (F.col("trade_date") <= F.lit(end).cast("date")))
    return make(read).where((F.col("trade_date") >= F.lit(start).cast("date")) & (F.col("trade_date") <= F.lit(end).cast("date")))


def post_process(values: DataFrame, clip: str = "quantile", mode: str = "zscore", boolean: bool = False) -> DataFrame:
    """(entity_code, trade_date, raw_value) -> processed, rank_value, percentile, score of each day's cross-section."""
    ready = x.finite(values)
    if boolean:
        ready = ready.withColumn("processed", F.col("raw_value"))
    else:
        ready = {"quantile": x.winsorize_quantile, "mad": x.winsorize_mad, "median": x.winsorize_median}[clip](ready)
    ranked = ready.withColumns({"rank_value": x.rank_desc("processed"), "percentile": x.pct_rank("processed")})
    return ranked.withColumn("score", x.score_boolean() if boolean else x.score(mode))


def compute_factor(panel: DataFrame, make: Callable[[DataFrame], DataFrame], start: str, end: str, window: int, clip: str = "quantile", mode: str = "zscore", boolean: bool = False) -> DataFrame:
    """A factor's values in [start, end]: formula with its look-back, then the cross-section of each day.

    Trimming first is the same, as a cross-section only sees its own day, and it saves the work of the look-back.
    """
    raw = with_lookback(panel, start, end, window, make).select("entity_code", "trade_date", F.col("raw_value").cast("double").alias("raw_value"))
    return post_process(raw, clip, mode, boolean)


def field_feature(panel: DataFrame, field: str) -> DataFrame:
    """A field of the panel as a feature: standardised, unless it is a flag."""
    boolean = dict(panel.dtypes)[field] == "boolean" or field.startswith("is_")
    values = panel.select("entity_code", "trade_date", F.col(field).cast("double").alias("raw_value"))
    return post_process(values, boolean=boolean)


def feature_matrix(members: DataFrame, panel: DataFrame, names: list[str], coverage: float = 0.8) -> DataFrame:
    """members (entity_code, trade_date) with a z-scored column per factor; all from one pass over the panel.

    A factor that covers fewer of the members than the share is an error.
    """
    wide = r.with_row_index(panel).select("entity_code", "trade_date", *[c.alias(n) for n, c in catalog.columns(names).items()])
    day = x.xs()
    scored = []
    for n in names:
        v = F.when(~F.isnan(n) & (F.abs(F.col(n)) < float("inf")), F.col(n))
        s = F.stddev_pop(v).over(day)
        scored.append(F.when(v.isNotNull(), F.when(s > 0, (v - F.avg(v).over(day)) / s).otherwise(0.0)).alias(n))
    joined = members.join(wide.select("entity_code", "trade_date", *scored), ["entity_code", "trade_date"], "left")
    joined = stored(joined)  # counted here, and read by who asked
    n = joined.agg(F.count("*").alias("__n"), *[F.count(c).alias(c) for c in names]).first()
    if low := [c for c in names if n["__n"] and n[c] < coverage * n["__n"]]:
        raise ValueError(f"factors below coverage: {low}")
    return joined


def probe_catalog(panel: DataFrame, entity: str | None = None, names: list[str] | None = None) -> DataFrame:
    """(factor_id, rows, finite): every factor of the catalogue over all entities or one, worked out and counted in one pass."""
    names = names or [*catalog.FLAT, *catalog.NESTED]
    rows = panel if entity is None else panel.where(F.col("entity_code") == entity)
    counts = catalog.finite_counts(rows, names)
    return counts.select("__rows", F.explode(F.array(*[F.struct(F.lit(n).alias("factor_id"), F.col(n).alias("finite")) for n in names])).alias("f")).select("f.factor_id", F.col("__rows").alias("rows"), "f.finite")
