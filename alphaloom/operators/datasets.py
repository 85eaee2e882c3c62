"""Model-ready datasets: labels, groups, splits, imputation."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.sinks import stored
from . import cross_section as x
from .evaluate import at_step
from .ordered import exact_quantiles


def _forward(prices: DataFrame, cal: DataFrame, h: int) -> DataFrame:
    if not 1 <= h <= 30:
        raise ValueError("the horizon must be from 1 to 30 sessions")
    return prices.join(cal, "trade_date").withColumn("ret", F.try_divide(at_step("price", h), F.col("price")) - 1)


def realized_labels(prices: DataFrame, cal: DataFrame, h: int) -> DataFrame:
    """prices (entity_code, trade_date, price) -> ret over h calendar sessions, and label: its rank from -1 to 1."""
    ready = x.dealt(_forward(prices, cal, h).where("ret is not null").select("entity_code", "trade_date", "ret"), "trade_date")
    return ready.select("entity_code", "trade_date", "ret", (2 * x.avg_pct_rank("ret") - 1).alias("label"))


def labelled_rows(rows: DataFrame, cal: DataFrame, h: int) -> DataFrame:
    """rows (entity_code, trade_date, price, ...) with ret and label of realized_labels, null where they have none.

    For rows that go along with their labels: one shuffle by entity and one by date serve all columns, and no join.
    """
    known = F.col("ret").isNotNull()
    ready = x.dealt(_forward(rows, cal, h).drop("idx"), "trade_date").withColumn("__known", known)
    share = x.mean_rank("ret", ["trade_date", "__known"]) / F.count(F.lit(1)).over(Window.partitionBy("trade_date", "__known"))
    return ready.withColumn("label", F.when(known, 2 * share - 1)).drop("__known")


def rank_label(prices: DataFrame, cal: DataFrame, h: int) -> DataFrame:
    return realized_labels(prices, cal, h).drop("ret")


def direction_label(prices: DataFrame, cal: DataFrame, h: int) -> DataFrame:
    """1 where the return is positive, else 0."""
    ready = _forward(prices, cal, h).where("ret is not null")
    return ready.select("entity_code", "trade_date", (F.col("ret") > 0).cast("int").alias("label"))


def return_paths(prices: DataFrame, cal: DataFrame, h: int, as_of: str | None = None) -> DataFrame:
    """(entity_code, trade_date, step, ret) for steps 1..h, up to a date: one window per step, no self-join."""
    dated = prices.join(cal, "trade_date")
    if as_of is not None:
        dated = dated.where(F.col("trade_date") <= F.lit(as_of).cast("date"))
    steps = [F.struct(F.lit(k).alias("step"), (F.try_divide(at_step("price", k), F.col("price")) - 1).alias("ret")) for k in range(1, h + 1)]
    return dated.withColumn("__steps", F.array(*steps)).select("entity_code", "trade_date", F.explode("__steps").alias("s")).select("entity_code", "trade_date", "s.*").where("ret is not null")


def style_groups(caps: DataFrame, coverage: float = 0.8) -> DataFrame:
    """caps (entity_code, trade_date, cap) -> group small or large: the first half of each date by (cap, code).

    Dates whose caps cover less than the share, or that lack a group, have no rows.
    """
    day = Window.partitionBy("trade_date")
    known = caps.withColumns({"__all": F.count(F.lit(1)).over(day), "__n": F.count("cap").over(day)}).where((F.col("__n") >= coverage * F.col("__all")) & (F.col("__n") >= 2))
    known = known.where("cap is not null").withColumn("__r", F.row_number().over(day.orderBy("cap", "entity_code")))
    return known.withColumn("group", F.when(F.col("__r") <= F.floor(F.col("__n") / 2), "small").otherwise("large")).drop("__all", "__n", "__r")


def style_features(features: DataFrame, groups: DataFrame, names: list[str]) -> DataFrame:
    """Group means of features per date."""
    return features.join(groups.select("entity_code", "trade_date", "group"), ["entity_code", "trade_date"]).groupBy("trade_date", "group").agg(*[F.avg(n).alias(n) for n in names])


def group_label(returns: DataFrame, groups: DataFrame, direction: bool = False) -> DataFrame:
    """(trade_date, group, label) from group mean returns: ranked -1 to 1 among groups, or 1 for a positive mean."""
    mean = returns.join(groups, ["entity_code", "trade_date"]).groupBy("trade_date", "group").agg(F.avg("ret").alias("ret"))
    if direction:
        return mean.select("trade_date", "group", (F.col("ret") > 0).cast("int").alias("label"))
    n = F.count(F.lit(1)).over(x.xs())
    return mean.withColumn("label", 2 * x.avg_pct_rank("ret") - 1).withColumn("__n", n).where("__n >= 2").select("trade_date", "group", "label")


def weighted_mean(df: DataFrame, keys: list[str], values: list[str], weight: str) -> DataFrame:
    """Per key the weighted mean of each value over the rows that have it; null where these weigh nothing."""
    w = F.col(weight)
    return df.groupBy(*keys).agg(*[F.try_divide(F.sum(w * F.col(v)), F.nullif(F.sum(F.when(F.col(v).isNotNull(), w)), F.lit(0.0))).alias(v) for v in values])


def industry_features(features: DataFrame, industries: DataFrame, names: list[str]) -> DataFrame:
    """Weighted means by date and industry; industries (entity_code, trade_date, industry, industry_weight)."""
    return weighted_mean(features.join(industries, ["entity_code", "trade_date"]), ["trade_date", "industry"], names, "industry_weight")


def industry_label(returns: DataFrame, industries: DataFrame) -> DataFrame:
    """Weighted mean returns of industries, ranked -1 to 1 per date; dates with one industry have none."""
    mean = weighted_mean(returns.join(industries, ["entity_code", "trade_date"]), ["trade_date", "industry"], ["ret"], "industry_weight").where("ret is not null")
    return mean.withColumn("label", 2 * x.avg_pct_rank("ret") - 1).withColumn("__n", F.count(F.lit(1)).over(x.xs())).where("__n >= 2").drop("__n")


def split_dates(dates: DataFrame, train: float = 0.6, valid: float = 0.2, gap: int = 0, least: int = 60) -> DataFrame:
    """dates (trade_date) -> (trade_date, split): by order, `gap` dates cut from the end of train and of valid.

    Fewer than `least` dates are an error. One row per date, so one window is small.
    """
    w = Window.orderBy("trade_date")
    n = dates.select("trade_date").distinct()
    total = n.count()
    if total < least:
        raise ValueError(f"{total} dates, {least} are needed")
    a, b = int(total * train), int(total * (train + valid))
    i = F.row_number().over(w) - 1
    split = F.when(i < a - gap, "train").when((i >= a) & (i < b - gap), "valid").when(i >= b, "test")
    return n.withColumn("split", split).where("split is not null")


def walk_forward(dates: list[dt.date], spark: SparkSession, train: int = 252, test: int = 21, step: int | None = None, most: int = 4, gap: int = 0, expanding: bool = False) -> DataFrame:
    """(window, split, start_date, end_date): planned backwards from the last date; expanding ones start at the first.

    The list of sessions is small; the windows come back as a DataFrame, first one first.
    """
    step = step or test
    if step < test:
        raise ValueError("windows must not overlap: step must be at least test")
    plans, end = [], len(dates)
    while len(plans) < most and end - test - gap - train >= 0:
        a = end - test
        plans.append(((0 if expanding else a - gap - train), a - gap - 1, a, end - 1))
        end -= step
    rows = []
    for i, (t0, t1, a, b) in enumerate(reversed(plans), 1):
        rows += [(i, "train", dates[t0], dates[t1]), (i, "test", dates[a], dates[b])]
    return spark.createDataFrame(rows, "window int, split string, start_date date, end_date date")


def fit_medians(train: DataFrame, names: list[str]) -> DataFrame:
    """One row: the exact median of each feature over the training rows, 0 for one without values."""
    long = train.select(*[F.col(n).cast("double").alias(n) for n in names]).unpivot([], names, "feature", "v")
    middle = exact_quantiles(long, "v", [0.5], ["feature"])
    one = lambda n: F.coalesce(F.max(F.when(F.col("feature") == n, F.col("q")[0])), F.lit(0.0)).alias(n)
    return middle.agg(*map(one, names))


def impute(df: DataFrame, medians: DataFrame, names: list[str]) -> DataFrame:
    """Nulls filled with the one row of medians."""
    one = medians.select(*[F.col(n).alias(f"__{n}") for n in names])
    return df.crossJoin(one).withColumns({n: F.coalesce(n, f"__{n}") for n in names}).drop(*[f"__{n}" for n in names])


def dataset_rows(features: DataFrame, labels: DataFrame, gap: int = 5, least: int = 60, classes: bool = False) -> DataFrame:
    """Features with label and split, gaps left as they are. classes: labels must be 0 and 1, and both occur in training."""
    joined = features.join(labels, ["entity_code", "trade_date"])
    rows = joined.join(split_dates(joined.select("trade_date"), gap=gap, least=least), "trade_date")
    if classes:
        seen = {(r["split"], r["label"]) for r in rows.select("split", F.col("label").cast("double").alias("label")).distinct().limit(10).collect()}
        if odd := {v for _, v in seen} - {0.0, 1.0}:
            raise ValueError(f"labels other than 0 and 1: {sorted(map(str, odd))}")
        if {v for s, v in seen if s == "train"} != {0.0, 1.0}:
            raise ValueError("the training rows hold one class only")
    return rows


def build_dataset(features: DataFrame, labels: DataFrame, names: list[str], gap: int = 5, least: int = 60, classes: bool = False) -> tuple[DataFrame, DataFrame]:
    """(dataset, manifest): dataset_rows, imputed with medians of the training rows; counts by split."""
    rows = stored(dataset_rows(features, labels, gap, least, classes))  # the split, the medians and the rows read them
    ready = impute(rows, fit_medians(rows.where("split = 'train'"), names), names)
    manifest = ready.groupBy("split").agg(F.count("*").alias("rows"), F.count_distinct("trade_date").alias("dates"), F.min("trade_date").alias("first_date"), F.max("trade_date").alias("last_date"))
    return ready, manifest


def incremental_slice(dataset: DataFrame, after: str, medians: DataFrame, names: list[str], least: int = 60) -> DataFrame:
    """The rows after a date, split anew, imputed with the medians of the earlier training rows."""
    new = dataset.drop("split").where(F.col("trade_date") > F.lit(after).cast("date"))
    return impute(new.join(split_dates(new.select("trade_date"), least=least), "trade_date"), medians, names)
