"""Whole reports: stability and distribution of predictions over time, long against short portfolios, quality of values.

Daily values are computed once and are small; phases, totals, warnings and status are read off them. Fixed values: the
bounds of every status and warning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.sinks import stored
from . import cross_section as x
from .evaluate import newey_west, rank_corr
from .metrics import psi
from .ordered import exact_quantiles, met
from .portfolio import annualised

PHASES = ("early", "middle", "recent")


def with_phase(daily: DataFrame) -> DataFrame:
    """Adds phase: the early, middle or recent third of the dates; the first thirds take the remainder. A row per date."""
    i, n = F.row_number().over(Window.orderBy("trade_date")) - 1, F.count(F.lit(1)).over(Window.partitionBy())
    placed = daily.withColumns({"__i": i, "__n": n})
    a = F.floor(F.col("__n") / 3) + (F.col("__n") % 3 > 0).cast("int")
    b = a + F.floor(F.col("__n") / 3) + (F.col("__n") % 3 > 1).cast("int")
    return placed.withColumn("phase", F.when(F.col("__i") < a, "early").when(F.col("__i") < b, "middle").otherwise("recent")).drop("__i", "__n")


def _codes(*found: tuple[Column, str]) -> Column:
    """The names of what holds, in order."""
    return F.array_compact(F.array(*[F.when(F.coalesce(holds, F.lit(False)), name) for holds, name in found]))


# --- stability ---


def stability_daily(df: DataFrame, k: int = 5, window: int = 20, least_per: int = 5) -> DataFrame:
    """df (trade_date, entity_code, score, label, ret) -> (trade_date, ic, spread, names, rolling_ic, rolling_spread, phase).

    Dates with fewer than k * least_per names, or a constant side, do not count. Rolling means are null below half a window.
    """
    sized = df.where("score is not null and label is not null and ret is not null").withColumn("__n", F.count(F.lit(1)).over(x.xs())).where(F.col("__n") >= k * least_per)
    ic = rank_corr(sized, ["trade_date"], "score", "label").where("ic is not null").select("trade_date", "ic", F.col("n").alias("names"))
    side = lambda b: F.avg(F.when(F.col("bucket") == b, F.col("ret")))
    spread = sized.withColumn("bucket", x.equal_count_bucket("score", k)).groupBy("trade_date").agg((side(k) - side(1)).alias("spread"))
    w, least = Window.orderBy("trade_date").rowsBetween(-(window - 1), 0), min(window, max(3, window // 2))
    rolling = lambda c: F.when(F.count(c).over(w) >= least, F.avg(c).over(w))
    return with_phase(ic.join(spread, "trade_date").withColumns({"rolling_ic": rolling("ic"), "rolling_spread": rolling("spread")}))


def stability_phases(daily: DataFrame) -> DataFrame:
    """daily of stability_daily -> per phase: dates, rows, mean, deviation, ratio and positive share of ic; of the spread."""
    positive = lambda c: F.coalesce(F.avg((F.col(c) > 0).cast("double")), F.lit(0.0))
    dev = F.coalesce(F.nanvl(F.stddev_samp("ic"), F.lit(0.0)), F.lit(0.0))
    s = daily.groupBy("phase").agg(
        F.min("trade_date").alias("first_date"), F.max("trade_date").alias("last_date"), F.count("*").alias("days"), F.sum("names").alias("rows"), F.avg("ic").alias("ic_mean"), dev.alias("ic_std"),
        positive("ic").alias("positive_ic"), F.coalesce(F.avg("spread"), F.lit(0.0)).alias("spread_mean"), positive("spread").alias("positive_spread"),
    )
    return s.withColumn("ic_ir", F.when(F.col("ic_std") > 0, F.col("ic_mean") / F.col("ic_std")).otherwise(0.0))


def stability_report(daily: DataFrame, horizon: int = 5) -> DataFrame:
    """One row: days, effective_days, ic_mean, t, significance, early, recent, change, recent_positive, warnings, status.

    Returns over `horizon` dates overlap, so t is corrected for as many lags less one, and that many dates count as one.
    """
    p = stability_phases(daily)
    of = lambda phase, c: F.max(F.when(F.col("phase") == phase, F.col(c)))
    ends = p.agg(of("early", "ic_mean").alias("early"), of("recent", "ic_mean").alias("recent"), of("recent", "positive_ic").alias("recent_positive"))
    whole = newey_west(daily, "ic", max(horizon - 1, 0)).select(F.col("n").alias("days"), F.col("mean").alias("ic_mean"), "t")
    c = F.col
    one = whole.crossJoin(ends).withColumns({"effective_days": c("days") / horizon, "change": c("recent") - c("early")})  # a row each
    significance = (
        F.when(c("effective_days") < 10, "small_sample").when(c("t").isNull(), "unavailable").when(c("t") >= 1.96, "significant")
        .when(c("t") >= 1.64, "suggestive").when(c("t") <= -1.96, "significant_negative").otherwise("insufficient")
    )
    ready = one.withColumn("significance", significance)
    warnings = _codes(
        (c("effective_days") < 10, "small_sample"), (c("recent") < 0, "recent_negative"), ((c("recent") >= 0) & (c("recent") < 0.02), "recent_weak"),
        (c("change") <= -0.05, "decay"), ((c("change") > -0.05) & (c("change") <= -0.02), "some_decay"), (c("recent_positive") < 0.5, "few_positive_days"),
        (c("significance").isin("insufficient", "unavailable"), "no_evidence"),
    )
    unstable = (c("ic_mean") <= 0) | (c("recent") < 0) | (c("change") <= -0.05)
    return ready.withColumn("warnings", warnings).withColumn("status", F.when(unstable, "unstable").when(F.size("warnings") > 0, "mixed").otherwise("stable"))


# --- distribution of raw predictions ---


def phased(df: DataFrame) -> DataFrame:
    """df (trade_date, ...) with the phase of its date."""
    days = with_phase(df.select("trade_date").distinct())
    return df.join(F.broadcast(days), "trade_date")  # a row per date


def distribution_windows(df: DataFrame, value: str = "raw_prediction", bins: int = 10) -> DataFrame:
    """df (trade_date, value) -> per phase: days, rows, mean, std, p05, p50, p95, mean_daily_std, mean_daily_spread, psi.

    psi is against the early phase, 0 for itself; the spread of a day is from its 10th to its 90th percentile.
    """
    rows = stored(phased(df.where(F.col(value).isNotNull()).select("trade_date", F.col(value).cast("double").alias("v"))))
    days = rows.groupBy("phase", "trade_date").agg(F.stddev_samp("v").alias("s"), F.percentile("v", F.array(F.lit(0.1), F.lit(0.9))).alias("q"))
    daily = days.groupBy("phase").agg(F.coalesce(F.avg("s"), F.lit(0.0)).alias("mean_daily_std"), F.avg(F.col("q")[1] - F.col("q")[0]).alias("mean_daily_spread"))
    whole = rows.groupBy("phase").agg(F.count_distinct("trade_date").alias("days"), F.count("*").alias("rows"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))
    q = exact_quantiles(rows, "v", [0.05, 0.5, 0.95], ["phase"]).select("phase", *[F.col("q")[i].alias(n) for i, n in enumerate(("p05", "p50", "p95"))])
    shift = psi(rows, "v", "phase", "early", bins).select("phase", "psi")
    return whole.join(q, "phase").join(daily, "phase").join(shift, "phase", "left").withColumn("psi", F.when(F.col("phase") == "early", 0.0).otherwise(F.col("psi")))


def distribution_histogram(df: DataFrame, value: str = "raw_prediction", bins: int = 10) -> DataFrame:
    """(phase, bin, n, share) of the early and the recent phase, in even bins from 1 between the 1st and 99th percentile of
    both; what lies outside is in the outer bins. Bins without rows are there."""
    rows = phased(df.where(F.col(value).isNotNull()).select("trade_date", F.col(value).cast("double").alias("v"))).where("phase <> 'middle'").select("phase", "v")
    ends = exact_quantiles(rows, "v", [0.01, 0.99], []).select(F.col("q")[0].alias("a"), F.col("q")[1].alias("b"))
    ends = ends.select(F.when(F.col("b") > F.col("a"), F.col("a")).otherwise(F.col("a") - 0.5).alias("a"), F.when(F.col("b") > F.col("a"), F.col("b")).otherwise(F.col("b") + 0.5).alias("b"))
    clipped = F.greatest(F.least("v", "b"), "a")
    bin_ = F.least(F.floor((clipped - F.col("a")) / (F.col("b") - F.col("a")) * bins), F.lit(bins - 1)).cast("int") + 1
    counts = met(rows, stored(ends), []).withColumn("bin", bin_).groupBy("phase", "bin").agg(F.count("*").alias("n"))
    grid = rows.sparkSession.createDataFrame([(p, i) for p in ("early", "recent") for i in range(1, bins + 1)], "phase string, bin int")
    full = grid.join(counts, ["phase", "bin"], "left").fillna(0, ["n"])
    return full.withColumn("share", F.try_divide("n", F.sum("n").over(Window.partitionBy("phase"))))


def distribution_report(windows: DataFrame) -> DataFrame:
    """windows of distribution_windows -> one row: latest_psi, std_ratio, median_shift, warnings, status."""
    of = lambda phase, c: F.max(F.when(F.col("phase") == phase, F.col(c)))
    s = windows.agg(of("recent", "psi").alias("latest_psi"), of("early", "std").alias("__s"), of("recent", "std").alias("__r"), of("early", "p50").alias("__a"), of("recent", "p50").alias("__b"))
    some = F.col("__s") > 1e-12
    one = s.select("latest_psi", F.when(some, F.col("__r") / F.col("__s")).otherwise(1.0).alias("std_ratio"), F.when(some, F.abs(F.col("__b") - F.col("__a")) / F.col("__s")).otherwise(0.0).alias("median_shift"))
    c = F.col
    warnings = _codes((c("latest_psi") >= 0.25, "severe_drift"), ((c("latest_psi") >= 0.1) & (c("latest_psi") < 0.25), "drift"), (c("std_ratio") < 0.5, "collapse"), (c("std_ratio") > 2, "wider"), (c("median_shift") >= 1, "median_shift"))
    severe = (c("latest_psi") >= 0.25) | (c("std_ratio") < 0.5) | (c("std_ratio") > 2)
    return one.withColumn("warnings", warnings).withColumn("status", F.when(severe, "severe").when(F.size("warnings") > 0, "warning").otherwise("stable"))


# --- overview ---


def known_in_time(df: DataFrame) -> DataFrame:
    """df (trade_date, feature_cutoff_at) -> (trade_date, rows, in_time, late): whether features were known by 15:00."""
    safe = F.coalesce(F.col("feature_cutoff_at") <= F.col("trade_date").cast("timestamp") + F.expr("INTERVAL 15 HOURS"), F.lit(False))
    return df.groupBy("trade_date").agg(F.count("*").alias("rows"), F.count(F.when(safe, 1)).alias("in_time"), F.count(F.when(~safe, 1)).alias("late"))


def score_histogram(df: DataFrame, bins: int = 10) -> DataFrame:
    """(trade_date, bin, n) of scores from -1 to 1 in even bins from 1; 1 itself is in the last. Empty bins are there."""
    b = F.least(F.floor((F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("score"))) + 1) / 2 * bins), F.lit(bins - 1)).cast("int") + 1
    counts = df.where("score is not null").groupBy("trade_date", b.alias("bin")).agg(F.count("*").alias("n"))
    grid = df.select("trade_date").distinct().withColumn("bin", F.explode(F.sequence(F.lit(1), F.lit(bins))))
    return grid.join(counts, ["trade_date", "bin"], "left").fillna(0, ["n"])


def day_over_day(df: DataFrame) -> DataFrame:
    """df (trade_date, entity_code, score) -> (trade_date, common, rho): Spearman of the scores with those of the date before,
    over the names that both have."""
    days = df.select("trade_date").distinct().withColumn("before", F.lag("trade_date").over(Window.orderBy("trade_date")))  # a row per date
    past = df.select(F.col("trade_date").alias("before"), "entity_code", F.col("score").alias("was"))
    both = df.join(F.broadcast(days), "trade_date").join(past, ["before", "entity_code"])
    return rank_corr(both, ["trade_date"], "score", "was", "rho").withColumnRenamed("n", "common")


# --- exposure ---


def size_exposure(df: DataFrame, k: int = 5) -> DataFrame:
    """df (trade_date, entity_code, score, cap) -> (size_bucket, universe, top, active): the share of each of k sizes among all
    names, among those of the highest of k scores, and the difference. Names without score or cap play no part."""
    known = df.where("score is not null and cap is not null").withColumns({"score_bucket": x.equal_count_bucket("score", k), "size_bucket": x.equal_count_bucket("cap", k)})
    counts = known.groupBy("size_bucket").agg(F.count("*").alias("n"), F.count(F.when(F.col("score_bucket") == k, 1)).alias("t"))
    all_ = Window.partitionBy()  # a row per size
    s = counts.select("size_bucket", (F.col("n") / F.sum("n").over(all_)).alias("universe"), F.try_divide("t", F.sum("t").over(all_)).alias("top"))
    return s.withColumn("active", F.col("top") - F.col("universe"))


def size_relation(df: DataFrame) -> DataFrame:
    """(trade_date, names, covered, coverage, rho): how many scored names have a cap, and the Spearman of score and cap."""
    s = df.where("score is not null").groupBy("trade_date").agg(F.count("*").alias("names"), F.count("cap").alias("covered"))
    rho = rank_corr(df.where("score is not null and cap is not null"), ["trade_date"], "score", "cap", "rho").select("trade_date", "rho")
    return s.withColumn("coverage", F.col("covered") / F.col("names")).join(rho, "trade_date", "left")


# --- long against short ---


def long_short(low: DataFrame, high: DataFrame, bench: DataFrame) -> DataFrame:
    """low, high (trade_date, ret, turnover, cost), bench (trade_date, bench) -> per date on which all are there: net returns
    of both, long_short, excess, the levels that each of them grows to, mean turnover and cost. A row per date."""
    side = lambda d, n: d.select("trade_date", (F.col("ret") - F.coalesce("cost", F.lit(0.0))).alias(f"{n}_return"), *[F.coalesce(c, F.lit(0.0)).alias(f"{n}_{c}") for c in ("turnover", "cost")])
    m = side(low, "low").join(side(high, "high"), "trade_date").join(bench.where("bench is not null").select("trade_date", "bench"), "trade_date")
    m = m.withColumns({"long_short": F.col("high_return") - F.col("low_return"), "excess": F.col("high_return") - F.col("bench"), "turnover": (F.col("low_turnover") + F.col("high_turnover")) / 2, "cost": (F.col("low_cost") + F.col("high_cost")) / 2})
    w = Window.orderBy("trade_date").rowsBetween(Window.unboundedPreceding, 0)
    grown = {f"{n}_nav": F.product(1 + F.col(c)).over(w) for n, c in (("low", "low_return"), ("high", "high_return"), ("long_short", "long_short"), ("bench", "bench"))}
    return m.withColumns(grown).drop("low_turnover", "high_turnover", "low_cost", "high_cost")


def long_short_summary(daily: DataFrame, ic: DataFrame, least: int = 25) -> DataFrame:
    """daily of long_short, ic (trade_date, n, ic) -> one row: annual, annual_excess, annual_long_short, turnover, ic_mean,
    ic_ir, max_drawdown, days, whole_days (with at least so many names)."""
    own = daily.join(ic.select("trade_date", "n", "ic"), "trade_date", "left").withColumn("fall", F.col("high_nav") / F.max("high_nav").over(Window.orderBy("trade_date").rowsBetween(Window.unboundedPreceding, 0)) - 1)
    yearly = lambda c: annualised(F.product(1 + F.col(c)), F.count("*"))
    s = own.agg(
        yearly("high_return").alias("annual"), yearly("excess").alias("annual_excess"), yearly("long_short").alias("annual_long_short"), F.avg("turnover").alias("turnover"), F.avg("ic").alias("ic_mean"),
        F.stddev_samp("ic").alias("__s"), F.min("fall").alias("max_drawdown"), F.count("*").alias("days"), F.count(F.when(F.col("n") >= least, 1)).alias("whole_days"),
    )
    return s.withColumn("ic_ir", F.when(F.col("__s") > 0, F.col("ic_mean") / F.col("__s"))).drop("__s")


# --- values ---


def value_status(quality: DataFrame, raw: str = "raw_value", processed: tuple[str, ...] = ("rank_value", "percentile", "score")) -> DataFrame:
    """quality (metric, rows, nulls, zeros, ...) of one factor -> (status, warnings): how far values were post-processed, and
    what is odd about them."""
    of = lambda m, c: F.max(F.when(F.col("metric") == m, F.col(c)))
    there = [of(p, "rows") - of(p, "nulls") for p in processed]
    s = quality.agg(F.max("rows").alias("rows"), of(raw, "nulls").alias("nulls"), of(raw, "zeros").alias("zeros"), F.array(*there).alias("there"))
    none, every = F.forall("there", lambda n: n == 0), F.forall("there", lambda n: n == F.col("rows"))
    status = F.when(F.coalesce("rows", F.lit(0)) == 0, "empty").when(none, "not_generated").when(every, "generated").otherwise("partial")
    c = F.col
    some = F.coalesce(c("rows"), F.lit(0)) > 0
    warnings = _codes(
        (~some, "no_values"), (some & (c("nulls") == c("rows")), "all_null"), (some & (c("nulls") < c("rows")) & (c("zeros") == c("rows") - c("nulls")), "all_zero"),
        (c("status") == "not_generated", "not_processed"), (c("status") == "partial", "partly_processed"),
    )
    return s.withColumn("status", status).select("status", warnings.alias("warnings"))
