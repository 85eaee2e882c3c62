"""Rolling functions: frames of the last n rows of one entity, short at its beginning.

Sums, moments and regressions are window aggregates. What depends on the lag of a row within the frame (weights,
positions, ranks) works on the frame as an array of at most n values, so plans do not grow with n.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .scalar import div, truth

ENTITY, DAY = "entity_code", "trade_date"


def w(n: int, entity: str = ENTITY, day: str = DAY) -> WindowSpec:
    return Window.partitionBy(entity).orderBy(day).rowsBetween(-(n - 1), 0)


def _rows(entity: str = ENTITY, day: str = DAY) -> WindowSpec:
    return Window.partitionBy(entity).orderBy(day)


def mean(x: Column, n: int) -> Column:
    return F.avg(x).over(w(n))


def sum_(x: Column, n: int) -> Column:
    return F.sum(x).over(w(n))


def max_(x: Column, n: int) -> Column:
    return F.max(x).over(w(n))


def min_(x: Column, n: int) -> Column:
    return F.min(x).over(w(n))


def count_(x: Column, n: int) -> Column:
    return F.count(x).over(w(n))


def std(x: Column, n: int) -> Column:
    """Sample deviation; one value has none."""
    return F.when(count_(x, n) > 1, F.stddev_samp(x).over(w(n)))


def var(x: Column, n: int) -> Column:
    return F.when(count_(x, n) > 1, F.var_samp(x).over(w(n)))


def skew(x: Column, n: int) -> Column:
    """Third central moment over sample variance to the power 1.5."""
    k = count_(x, n).cast("double")
    return F.when(k > 1, F.skewness(x).over(w(n)) * F.pow((k - 1) / k, F.lit(1.5)))


def kurt(x: Column, n: int) -> Column:
    """Fourth central moment over squared sample variance."""
    k = count_(x, n).cast("double")
    return F.when(k > 1, (F.kurtosis(x).over(w(n)) + 3) * F.pow((k - 1) / k, F.lit(2.0)))


def quantile(x: Column, n: int, q: float) -> Column:
    """Exact, with linear interpolation."""
    return F.percentile(x, F.lit(q)).over(w(n))


def med(x: Column, n: int) -> Column:
    return quantile(x, n, 0.5)


def corr(x: Column, y: Column, n: int) -> Column:
    """Pearson, over the rows that have both; null where either is constant."""
    a, b = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    spread = F.stddev_pop(a).over(w(n)) * F.stddev_pop(b).over(w(n))
    return div(F.covar_pop(a, b).over(w(n)), F.nullif(spread, F.lit(0.0)))


def cov(x: Column, y: Column, n: int) -> Column:
    k = F.count(F.when(x.isNotNull() & y.isNotNull(), 1)).over(w(n))
    return F.when(k > 1, F.covar_samp(x, y).over(w(n)))


def frame(x: Column, n: int) -> Column:
    """The frame as an array, the current row first. Structs keep the places of nulls."""
    return F.reverse(F.collect_list(F.struct(x.cast("double").alias("v"))).over(w(n)))["v"]


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + F.coalesce(v, F.lit(0.0)))


def _weighted(x: Column, n: int, weight) -> Column:
    """Mean of the frame under weight(lag), over the lags that have a value."""
    values = frame(x, n)
    top = _total(F.transform(values, lambda v, k: v * weight(k)))
    return div(top, _total(F.transform(values, lambda v, k: F.when(v.isNotNull(), weight(k)))))


def mad(x: Column, n: int) -> Column:
    """Mean absolute deviation from the frame's own mean."""
    values, centre = frame(x, n), mean(x, n)
    return div(_total(F.transform(values, lambda v: F.abs(v - centre))), count_(x, n))


def ema(x: Column, n: int) -> Column:
    """n terms with weights alpha (1 - alpha)^lag, alpha = 2 / (n + 1)."""
    alpha = 2 / (n + 1)
    return _weighted(x, n, lambda k: F.lit(alpha) * F.pow(F.lit(1 - alpha), k.cast("double")))


def half_life(x: Column, n: int, days: float) -> Column:
    """n terms whose weight halves every so many rows."""
    return _weighted(x, n, lambda k: F.pow(F.lit(0.5), k.cast("double") / days))


def wma(x: Column, n: int) -> Column:
    """Weights n, n - 1, ... from the current row back."""
    return _weighted(x, n, lambda k: F.lit(float(n)) - k)


def ts_rank(x: Column, n: int) -> Column:
    """Share of the frame's values that are at most the current one."""
    values = frame(x, n)
    return F.when(x.isNotNull(), div(F.size(F.filter(values, lambda v: v <= x)), count_(x, n)))


def _index(x: Column, n: int, extreme) -> Column:
    values = frame(x, n)
    return F.when(count_(x, n) > 0, count_(x, n) - F.array_position(values, extreme(values)) + 1)


def idx_max(x: Column, n: int) -> Column:
    """Values of the frame minus the place of the latest maximum, current row 1, plus 1."""
    return _index(x, n, F.array_max)


def idx_min(x: Column, n: int) -> Column:
    return _index(x, n, F.array_min)


def row_index(entity: str = ENTITY, day: str = DAY) -> Column:
    return F.row_number().over(_rows(entity, day)).cast("double")


def slope(x: Column, n: int) -> Column:
    """Least squares over row numbers, nulls left out. Needs a column `row_index`, see with_row_index."""
    return F.when(count_(x, n) > 1, F.regr_slope(x, F.col("row_index")).over(w(n)))


def rsquare(x: Column, n: int) -> Column:
    return F.when(count_(x, n) > 1, F.regr_r2(x, F.col("row_index")).over(w(n)))


def resi(x: Column, n: int) -> Column:
    """The current value minus the fit at the current row."""
    fit = F.regr_intercept(x, F.col("row_index")).over(w(n)) + slope(x, n) * F.col("row_index")
    return x - fit


def with_row_index(df: DataFrame) -> DataFrame:
    return df.withColumn("row_index", row_index())


def ref(x: Column, n: int) -> Column:
    """n rows back; only the past can be asked for."""
    if n <= 0:
        raise ValueError("n must be positive: no look-ahead")
    return F.lag(x, n).over(_rows())


def delta(x: Column, n: int) -> Column:
    return x - ref(x, n)


def period_return(x: Column, n: int) -> Column:
    return div(x, F.nullif(ref(x, n), F.lit(0.0))) - 1


def first_true(condition: Column, n: int) -> Column:
    """1 if true now and at none of the n - 1 rows before."""
    before = F.sum(truth(condition)).over(_rows().rowsBetween(-(n - 1), -1)) if n > 1 else F.lit(0)
    return ((truth(condition) == 1) & (F.coalesce(before, F.lit(0)) == 0)).cast("int")


def stage(df: DataFrame, **columns: Column) -> DataFrame:
    """A level of a nested window: the columns exist for the next one."""
    return df.withColumns(columns)
