"""Diagnostics of predictions, factors and training."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import bands
from ..sources.sinks import stored
from . import cross_section as x
from .evaluate import newey_west, rank_corr, rank_corrs
from .metrics import ks, psi
from .vectors import pair_correlations, wide_correlations

PAIR_LEAST = 30


def quantile_diagnostics(df: DataFrame, k: int = 5, least_per: int = 5) -> DataFrame:
    """df (trade_date, entity_code, score, ret) -> (bucket, n, mean_ret) over dates with enough names per bucket."""
    sized = df.withColumn("__n", F.count(F.lit(1)).over(x.xs())).where(F.col("__n") >= k * least_per)
    daily = sized.withColumn("bucket", x.equal_count_bucket("score", k)).groupBy("trade_date", "bucket").agg(F.count("*").alias("n"), F.avg("ret").alias("ret"))
    return daily.groupBy("bucket").agg(F.sum("n").alias("n"), F.count("*").alias("days"), F.avg("ret").alias("mean_ret"))


def daily_spread(df: DataFrame, k: int = 5, least_per: int = 5) -> DataFrame:
    """(trade_date, spread): mean return of the top bucket minus that of the bottom one."""
    sized = df.withColumn("__n", F.count(F.lit(1)).over(x.xs())).where(F.col("__n") >= k * least_per)
    b = sized.withColumn("bucket", x.equal_count_bucket("score", k))
    return b.groupBy("trade_date").agg((F.avg(F.when(F.col("bucket") == k, F.col("ret"))) - F.avg(F.when(F.col("bucket") == 1, F.col("ret")))).alias("spread"))


def quantile_report(df: DataFrame, k: int = 5, least_per: int = 5, horizon: int = 1, every: int = 1) -> DataFrame:
    """One row about the buckets' returns: spread_mean, spread_median, positive_ratio, t, effective_days, significance,
    monotonicity of the means, adjacent (share of steps that do not fall), daily_monotonicity, daily_positive, status.

    Returns over `horizon` dates, taken every `every` dates, overlap; t is corrected for as many lags. Fixed values: the
    bounds of significance and status.
    """
    overlap = max(1.0, horizon / every)
    sized = df.withColumn("__n", F.count(F.lit(1)).over(x.xs())).where(F.col("__n") >= k * least_per)
    daily = sized.withColumn("bucket", x.equal_count_bucket("score", k)).groupBy("trade_date", "bucket").agg(F.avg("ret").alias("ret"))
    spread = daily.groupBy("trade_date").agg((F.max(F.when(F.col("bucket") == k, F.col("ret"))) - F.max(F.when(F.col("bucket") == 1, F.col("ret")))).alias("spread")).where("spread is not null")
    own = spread.agg(F.avg("spread").alias("spread_mean"), F.percentile("spread", F.lit(0.5)).alias("spread_median"), F.avg((F.col("spread") > 0).cast("double")).alias("positive_ratio"), (F.count("*") / overlap).alias("effective_days"))
    t = newey_west(spread, "spread", max(round(overlap) - 1, 0)).select("t")
    means = daily.groupBy("bucket").agg(F.avg("ret").alias("mean")).withColumn("one", F.lit(1))  # k rows
    order = rank_corr(means, ["one"], "bucket", "mean", "monotonicity").select(F.coalesce("monotonicity", F.lit(0.0)).alias("monotonicity"))
    step = F.lead("mean").over(Window.partitionBy("one").orderBy("bucket")) - F.col("mean")
    steps = means.withColumn("step", step).agg(F.avg(F.when(F.col("step").isNotNull(), (F.col("step") >= 0).cast("double"))).alias("adjacent"))
    whole = _enough(daily, ["trade_date"], k)
    by_day = rank_corr(whole, ["trade_date"], "bucket", "ret", "m").agg(F.avg("m").alias("daily_monotonicity"), F.avg((F.col("m") > 1e-9).cast("double")).alias("daily_positive"))
    out = own.crossJoin(t).crossJoin(order).crossJoin(steps).crossJoin(by_day)  # a row each
    c = F.col
    significance = F.when(c("effective_days") < 10, "small_sample").when(c("t").isNull(), "unavailable").when(c("t") >= 1.96, "significant").when(c("t") >= 1.64, "suggestive").when(c("t") <= -1.96, "significant_negative").otherwise("insufficient")
    strong = (c("spread_mean") > 0) & (c("monotonicity") >= 0.8) & (c("adjacent") >= 0.75)
    status = F.when(strong, "strong").when((c("spread_mean") > 0) & (c("monotonicity") > 0), "mixed").when((c("spread_mean") < 0) | (c("monotonicity") < 0), "inverse").otherwise("weak")
    return out.withColumns({"significance": significance, "status": status})


def stability(daily: DataFrame, window: int = 20, least: int = 10) -> DataFrame:
    """daily (trade_date, ic) with rolling (null below `least` values) and phase: early, middle or recent third.

    The first thirds take the remainder. One row per date, so the windows are small.
    """
    order = Window.orderBy("trade_date")
    w = order.rowsBetween(-(window - 1), 0)
    n = F.count(F.lit(1)).over(Window.partitionBy())
    i = F.row_number().over(order) - 1
    a = F.floor(n / 3) + (n % 3 > 0).cast("int")
    b = a + F.floor(n / 3) + (n % 3 > 1).cast("int")
    return daily.withColumns({"rolling": F.when(F.count("ic").over(w) >= least, F.avg("ic").over(w)), "phase": F.when(i < a, "early").when(i < b, "middle").otherwise("recent")})


def stability_summary(daily: DataFrame, lag: int = 4) -> DataFrame:
    """(phase, days, mean, std) of each third, and the t of all under phase `all`."""
    s = stability(daily).groupBy("phase").agg(F.count("ic").alias("days"), F.avg("ic").alias("mean"), F.stddev_samp("ic").alias("std"), F.lit(None).cast("double").alias("t"))
    whole = newey_west(daily, "ic", lag).select(F.lit("all").alias("phase"), F.col("n").alias("days"), "mean", F.lit(None).cast("double").alias("std"), "t")
    return s.unionByName(whole)


def exposure(df: DataFrame, k: int = 5) -> DataFrame:
    """df (trade_date, entity_code, score, cap) -> the full (score_bucket, size_bucket) grid: names and share."""
    known = df.where("score is not null and cap is not null").withColumns({"score_bucket": x.equal_count_bucket("score", k), "size_bucket": x.equal_count_bucket("cap", k)})
    counts = known.groupBy("score_bucket", "size_bucket").agg(F.count("*").alias("names"))
    spark = df.sparkSession
    one = spark.range(1, k + 1)
    grid = one.select(F.col("id").cast("int").alias("score_bucket"), F.explode(F.sequence(F.lit(1), F.lit(k))).alias("size_bucket"))
    full = grid.join(counts, ["score_bucket", "size_bucket"], "left").fillna(0, ["names"])
    return full.withColumn("share", F.try_divide(F.col("names"), F.sum("names").over(Window.partitionBy("score_bucket"))))


def concentration(weights: DataFrame) -> DataFrame:
    """weights (trade_date, industry, weight) -> (trade_date, industries, hhi, top_share)."""
    s = weights.groupBy("trade_date", "industry").agg(F.sum("weight").alias("w")).withColumn("p", F.col("w") / F.sum("w").over(x.xs()))
    return s.groupBy("trade_date").agg(F.count("*").alias("industries"), F.sum(F.col("p") ** 2).alias("hhi"), F.max("p").alias("top_share"))


def distribution(df: DataFrame, value: str, lo: float = -1.0, hi: float = 1.0, bins: int = 10) -> DataFrame:
    """(bin, n): fixed-width bins; values beyond the ends fall into the outer ones."""
    b = F.floor((F.greatest(F.lit(lo), F.least(F.lit(hi), F.col(value))) - lo) / (hi - lo) * bins)
    return df.where(F.col(value).isNotNull()).groupBy(F.least(b, F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def daily_quantiles(df: DataFrame, value: str, points: tuple[float, ...] = (0.1, 0.5, 0.9)) -> DataFrame:
    return df.groupBy("trade_date").agg(*[F.percentile(value, F.lit(p)).alias(f"q{int(100 * p)}") for p in points])


def overview(df: DataFrame, n: int = 10) -> DataFrame:
    """df (trade_date, entity_code, score) -> per date: names, mean, deviation, and how many of the top n entered."""
    top = df.withColumn("__r", x.rank_first("score")).where(F.col("__r") <= n).select("trade_date", "entity_code")
    days = df.select("trade_date").distinct().withColumn("before", F.lag("trade_date").over(Window.orderBy("trade_date")))
    past = top.withColumnRenamed("trade_date", "before")
    new = top.join(days, "trade_date").join(past, ["before", "entity_code"], "left_anti").groupBy("trade_date").agg(F.count("*").alias("entered"))
    s = df.groupBy("trade_date").agg(F.count("score").alias("names"), F.avg("score").alias("mean"), F.stddev_pop("score").alias("std"))
    return s.join(new, "trade_date", "left").fillna(0, ["entered"])


#: The five even bands of a score from -1 to 1 that the overview counts.
OVERVIEW_EDGES, OVERVIEW_BANDS = (-0.6, -0.2, 0.2, 0.6), ("very_low", "low", "middle", "high", "very_high")


def band_counts(df: DataFrame) -> DataFrame:
    """Names per date and band of the score, a column per band."""
    return df.withColumn("band", bands(F.col("score"), OVERVIEW_EDGES, OVERVIEW_BANDS)).groupBy("trade_date").pivot("band", list(OVERVIEW_BANDS)).agg(F.count(F.lit(1))).fillna(0)


def calibration(df: DataFrame, k: int = 10, least: int = 20) -> DataFrame:
    """df (percentile, ret) of completed paths -> per percentile bucket: n, mean, p10, p50, p90, hit; null below `least`."""
    b = F.greatest(F.lit(1), F.ceil(F.col("percentile") * k - 1e-9)).cast("int").alias("bucket")
    s = df.where("ret is not null").groupBy(b).agg(F.count("*").alias("n"), F.avg("ret").alias("mean"), *[F.percentile("ret", F.lit(p)).alias(f"p{int(100 * p)}") for p in (0.1, 0.5, 0.9)], F.avg((F.col("ret") > 0).cast("double")).alias("hit"))
    return s.withColumns({c: F.when(F.col("n") >= least, F.col(c)) for c in ("mean", "p10", "p50", "p90", "hit")})


def compare_models(df: DataFrame, common: bool = False) -> DataFrame:
    """df (trade_date, entity_code, model_id, score) -> (model_a, model_b, days, rho): mean daily Spearman on names that both
    have, or that all models have."""
    return pair_correlations(df, common=common).withColumnsRenamed({"a": "model_a", "b": "model_b"})


def ic_stats(daily: DataFrame, keys: list[str]) -> DataFrame:
    """daily (keys, trade_date, ic) -> days, rank_ic, ic_ir, positive_rate; 0 without dates, a deviation of 0 for one."""
    s = daily.groupBy(*keys).agg(F.count("ic").alias("days"), F.avg("ic").alias("m"), F.stddev_samp("ic").alias("d"), F.avg((F.col("ic") > 0).cast("double")).alias("positive_rate"))
    mean, dev = F.coalesce("m", F.lit(0.0)), F.coalesce(F.nanvl("d", F.lit(0.0)), F.lit(0.0))
    return s.select(*keys, "days", mean.alias("rank_ic"), (mean / (dev + 1e-12)).alias("ic_ir"), F.coalesce("positive_rate", F.lit(0.0)).alias("positive_rate"))


def _enough(long: DataFrame, keys: list[str], least: int) -> DataFrame:
    """The rows of groups with at least so many."""
    return long.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(*keys))).where(F.col("__n") >= least).drop("__n")


def redundancy(long: DataFrame, least: int = PAIR_LEAST, limit: float = 0.85, names: list[str] | None = None) -> DataFrame:
    """long (trade_date, entity_code, feature, value) -> (feature_a, feature_b, days, rho, redundant): mean daily Spearman.

    With names the rows are wide: one per date and entity, a column per feature; they are shuffled once.
    """
    p = pair_correlations(long.where("value is not null"), "feature", "value", least) if names is None else wide_correlations(long, sorted(names), least)
    return p.select(F.col("a").alias("feature_a"), F.col("b").alias("feature_b"), "days", "rho", F.coalesce((F.abs("rho") >= limit).cast("int"), F.lit(0)).alias("redundant"))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """edges (a, b) -> (node, leader): leader the smallest node that hangs together with a node.

    In every round each leader follows the smallest of its neighbours, chains of those that follow each other are cut short by
    jumps, and leaders that are one now are contracted: what is left shrinks by more than half each time, so a path of
    thousands takes a few rounds. Rounds are stored. Nodes whose only edge is to themselves lead themselves.
    """
    both = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null")
    ways = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))  # edges are worked out once
    links = stored(both.select(ways.alias("w")).select("w.a", "w.b").distinct())
    labels, left = links.select(F.col("a").alias("node"), F.col("a").alias("leader")).distinct(), links.where("a <> b")
    while left.take(1):
        follows = stored(left.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("of"), F.least("a", "b").alias("to")))
        while True:
            jump = follows.select(F.col("of").alias("to"), F.col("to").alias("__far"))
            moved = stored(follows.join(jump, "to").select("of", F.col("to").alias("__was"), F.col("__far").alias("to")))
            follows = moved.drop("__was")
            if not moved.where("to <> __was").take(1):
                break
        own = lambda c: follows.select(F.col("of").alias(c), F.col("to").alias(f"__{c}"))  # noqa: B023, E731
        labels = stored(labels.join(own("leader"), "leader", "left").select("node", F.coalesce("__leader", "leader").alias("leader")))
        left = stored(left.join(own("a"), "a").join(own("b"), "b").select(F.col("__a").alias("a"), F.col("__b").alias("b")).where("a <> b").distinct())
    return labels


def redundancy_groups(pairs: DataFrame, strength: DataFrame) -> DataFrame:
    """pairs of redundancy, strength (feature, rank_ic, ic_ir) -> (leader, feature, keep) of features that hang together.

    leader is the first feature of a group by name; kept is the one of largest |ic_ir|, then |rank_ic|, then last by name.
    """
    grouped = components(pairs.where("redundant = 1"), "feature_a", "feature_b").withColumnRenamed("node", "feature")
    best = Window.partitionBy("leader").orderBy(F.abs("ic_ir").desc(), F.abs("rank_ic").desc(), F.col("feature").desc())
    return grouped.join(strength.select("feature", "rank_ic", "ic_ir"), "feature").select("leader", "feature", (F.row_number().over(best) == 1).cast("int").alias("keep"))


def factor_audit(df: DataFrame, split: str = "split", least: int = PAIR_LEAST, names: list[str] | None = None) -> DataFrame:
    """df (trade_date, entity_code, split, feature, value, label) -> per feature the daily IC of train and valid, and verdicts.

    Dates with fewer than `least` names do not count. Fixed values: weak below 0.005 on validation, improved from 1.1,
    stable from 0.5 of the training strength; worth keeping from 0.02. With names the rows are wide: one per date and
    entity, a column per feature; they are shuffled once. Wide rows are read twice.
    """
    rows = df.where(F.col(split).isin("train", "valid"))
    if names is None:
        daily, found = rank_corr(rows, ["feature", split, "trade_date"], "value", "label"), df.select("feature").distinct()
    else:
        daily = rank_corrs(rows, [split, "trade_date"], names, "label")
        have = df.agg(*[F.count(n).alias(f"__{i}") for i, n in enumerate(names)])
        found = have.select(F.explode(F.array(*[F.when(F.col(f"__{i}") > 0, n) for i, n in enumerate(names)])).alias("feature")).where("feature is not null")
    own = stored(ic_stats(daily.where(F.col("n") >= least), ["feature", split]))  # two rows per feature
    for side in ("train", "valid"):
        found = found.join(own.where(F.col(split) == side).select("feature", *[F.col(c).alias(f"{side}_{c}") for c in ("rank_ic", "ic_ir", "positive_rate", "days")]), "feature", "left")
    wide = found.fillna(0)
    train, valid = F.abs("train_rank_ic"), F.abs("valid_rank_ic")
    status = (
        F.when(valid < 0.005, "weak")
        .when(F.col("train_rank_ic") * F.col("valid_rank_ic") < 0, "reversed")
        .when(valid >= 1.10 * train, "improved")
        .when(valid >= 0.50 * train, "stable")
        .otherwise("decayed")
    )
    held = F.col("status").isin("stable", "improved") & (valid >= 0.02)
    advice = F.when(held, "keep_candidate").when(F.col("status").isin("reversed", "weak"), "review").otherwise("observe")
    return wide.withColumns({"retention": F.when(train > 1e-12, valid / train), "status": status}).withColumn("recommendation", advice)


def walk_forward_attribution(df: DataFrame, names: list[str], windows: DataFrame, model_ic: DataFrame) -> DataFrame:
    """What changed for each feature between the training and the test dates of each window.

    df (trade_date, entity_code, label, names...), windows (window, split train or test, start_date, end_date), model_ic
    (window, model_rank_ic) -> (window, feature, train_rank_ic, test_rank_ic, retention, psi, ks, status, window_status,
    weakest, cause). Dates with less than half the median number of names (2 to 30) do not count. Windows are turned into
    their dates, so that the join is by equality; a date's ranks serve all windows that it is in. df is read several times:
    store it. Fixed values: 0.01 as the least IC that counts, 0.5 and 0.02.
    """
    days = windows.select("window", F.col("split").alias("side"), F.explode(F.sequence("start_date", "end_date")).alias("trade_date"))
    sides = days.groupBy("trade_date").agg(F.collect_list(F.struct("window", "side")).alias("w"))  # a row per date
    met = df.select("trade_date", "label", *names).join(F.broadcast(sides), "trade_date")
    long = met.unpivot(["trade_date", "w"], names, "feature", "v").select("feature", "v", F.explode("w").alias("w")).select("w.window", "w.side", "feature", "v")
    sizes = stored(df.groupBy("trade_date").agg(F.count("*").alias("n")))
    half = sizes.agg(F.greatest(F.lit(2), F.least(F.lit(30), F.rint(F.percentile("n", F.lit(0.5)) * 0.5))).alias("least"))
    daily = rank_corrs(met, ["trade_date"], names, "label").crossJoin(half).where("n >= least")
    ic = stored(ic_stats(daily.join(days, "trade_date"), ["window", "side", "feature"]))
    out = sizes.join(days, "trade_date").select("window", F.explode(F.array(*map(F.lit, names))).alias("feature")).distinct()
    for side in ("train", "test"):
        out = out.join(ic.where(F.col("side") == side).select("window", "feature", F.col("rank_ic").alias(f"{side}_rank_ic")), ["window", "feature"], "left")
    out = out.fillna(0.0, ["train_rank_ic", "test_rank_ic"])
    shift = psi(long, "v", "side", "train", keys=("window", "feature")).where("side = 'test'").select("window", "feature", "psi")
    out = out.join(shift, ["window", "feature"], "left").join(ks(long, "v", "side", "train", "test", ("window", "feature")), ["window", "feature"], "left")
    train, test = F.col("train_rank_ic"), F.col("test_rank_ic")
    kept = F.when(F.abs(train) >= 0.01, F.abs(test) / F.abs(train))
    flipped = (F.abs(train) >= 0.01) & (F.abs(test) >= 0.01) & (train * test < 0)
    status = F.when(flipped, "reversed").when(kept < 0.5, "decayed").when(F.col("psi").isNull() | (F.col("psi") >= 0.25), "shifted").otherwise("stable")
    own = out.withColumns({"retention": kept, "status": status}).join(model_ic.select("window", "model_rank_ic"), "window", "left")
    w = Window.partitionBy("window")
    some = {s: F.count(F.when(F.col("status") == s, 1)).over(w) > 0 for s in ("reversed", "decayed", "shifted")}
    model = F.col("model_rank_ic")
    of_window = F.when(model < 0, "failed").when(some["reversed"] | some["decayed"], "warning").when(model < 0.02, "weak").otherwise("stable")
    cause = F.when(some["reversed"], "factor_sign_reversal").when(some["decayed"], "factor_signal_decay").when(some["shifted"], "feature_distribution_shift").otherwise("model_or_market_regime")
    lowest = F.min(F.struct(F.coalesce(model, F.lit(0.0)).alias("ic"), "window")).over(Window.partitionBy())  # a row per window and feature
    return own.withColumns({"window_status": of_window, "cause": cause, "weakest": (lowest["window"] == F.col("window")).cast("int")}).drop("model_rank_ic")


def ensemble_diagnostics(df: DataFrame, scenarios: DataFrame) -> DataFrame:
    """df (trade_date, entity_code, model_id, score, label), scenarios (scenario, model_id, weight) -> mean IC per scenario.

    Scenarios (leave one out, other weights) are rows of a small table; all are scored in one pass.
    """
    s = df.join(scenarios, "model_id").groupBy("scenario", "trade_date", "entity_code").agg(F.round(F.sum(F.col("weight") * F.col("score")) / F.sum("weight"), 12).alias("score"), F.first("label").alias("label"))
    return rank_corr(s, ["scenario", "trade_date"], "score", "label").groupBy("scenario").agg(F.count("ic").alias("days"), F.avg("ic").alias("ic"), F.stddev_samp("ic").alias("ic_std"))


def training_curve(history: DataFrame) -> DataFrame:
    """history (run, step, train, valid; losses) -> per run best_step, final_step, gap, rebound, improvement, status.

    gap: of the valid loss to the train loss at the best step, rebound: of the final valid loss to the best one, both as
    shares of the best and not below 0; improvement: from the first to the best, as a share of the first. Fixed values:
    the limits of status.
    """
    first, last = F.min_by("valid", "step"), F.max_by("valid", "step")
    s = history.where("train is not null and valid is not null").groupBy("run").agg(F.min(F.struct("valid", "step", "train")).alias("b"), first.alias("first"), last.alias("last"), F.max("step").alias("final_step"), F.count("*").alias("points"))
    best = F.col("b.valid")
    share = lambda x, of: F.greatest(F.lit(0.0), x / F.greatest(F.abs(of), F.lit(1e-12)))
    out = s.select("run", "points", F.col("b.step").alias("best_step"), "final_step", share(best - F.col("b.train"), best).alias("gap"), share(F.col("last") - best, best).alias("rebound"), share(F.col("first") - best, F.col("first")).alias("improvement"))
    severe = (F.col("gap") >= 0.50) | (F.col("rebound") >= 0.20)
    warning = ((F.col("points") >= 3) & (F.col("improvement") < 0.001)) | (F.col("gap") >= 0.20) | (F.col("rebound") >= 0.05)
    return out.withColumn("status", F.when(severe, "severe").when(warning, "warning").otherwise("stable"))


def curve_points(history: DataFrame, most: int = 300) -> DataFrame:
    """At most about `most` evenly spaced points of each run's curve, its best and its last among them."""
    own = Window.partitionBy("run")
    p = history.withColumns({"i": F.row_number().over(own.orderBy("step")) - 1, "n": F.count(F.lit(1)).over(own), "best": F.min(F.struct("valid", "step")).over(own)})
    step = (F.col("n") - 1) / (most - 1)
    even = F.floor(F.ceil(F.col("i") / step) * step) == F.col("i")
    return p.where((F.col("n") <= most) | even | (F.col("step") == F.col("best.step")) | (F.col("i") == F.col("n") - 1)).drop("i", "n", "best")
