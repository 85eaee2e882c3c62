"""Metrics of predictions, gates, leaderboards and ensembles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import cross_section as x
from . import ordered
from .joins import latest_predictions


def prediction_frame(raw: DataFrame, scope: str = "stock") -> DataFrame:
    """raw (entity_code, trade_date, raw_prediction) with rank_value, percentile, score and feature_cutoff_at."""
    return raw.withColumns({
        "rank_value": x.rank_first("raw_prediction"), "percentile": x.avg_pct_rank("raw_prediction"), "score": x.rank_score("raw_prediction", scope),
        "feature_cutoff_at": F.col("trade_date").cast("timestamp") + F.expr("INTERVAL 15 HOURS"),
    })


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b)


def metrics(df: DataFrame, keys: list[str]) -> DataFrame:
    """df (keys, trade_date, prediction, label) -> rows, days, rmse, mean daily IC, deviation and ratio.

    One pass: a date gives its IC and the sums of its errors. Rows without prediction or label count in rows alone; what has
    no others, or a null key, has no metrics.
    """
    by = [*keys, "trade_date"]
    whole = F.col("prediction").isNotNull() & F.col("label").isNotNull()
    rows = x.dealt(df.select(*by, "prediction", "label"), *by).withColumn("__whole", whole)
    rank = lambda v: F.when(F.col("__whole"), x.mean_rank(v, [*by, "__whole"]))
    error = (F.col("prediction") - F.col("label")) ** 2
    daily = rows.withColumns({"__a": rank("prediction"), "__b": rank("label")}).groupBy(*by).agg(
        F.count("*").alias("__rows"), F.count(F.when(F.col("__whole"), 1)).alias("__n"), F.sum(error).alias("__e"),
        F.covar_pop("__a", "__b").alias("__c"), (F.stddev_pop("__a") * F.stddev_pop("__b")).alias("__s"),
    ).withColumn("__ic", _ratio(F.col("__c"), F.col("__s")))
    own = daily.groupBy(*keys).agg(
        F.coalesce(F.sum("__rows"), F.lit(0)).alias("rows"), F.sqrt(F.try_divide(F.sum("__e"), F.sum("__n"))).alias("rmse"),
        F.count("__ic").alias("days"), F.avg("__ic").alias("ic"), F.stddev_samp("__ic").alias("ic_std"), F.sum("__n").alias("__n"),
    )
    for k in keys:
        own = own.where(F.col(k).isNotNull())
    met = own.where("__n > 0") if keys else own
    return met.drop("__n").withColumn("icir", _ratio(F.col("ic"), F.col("ic_std")))


def evaluate_stored(stored: DataFrame, labels: DataFrame, keys: list[str]) -> DataFrame:
    """stored (keys, trade_date, entity_code, score, updated_at, computed_at, run_id), labels (trade_date, entity_code,
    label) -> metrics of the latest score of each key, entity and date against what came of it.

    The latest score is found in the parts and in the order in which labels are met."""
    parts = x.dealt(stored, "trade_date", "entity_code")
    latest = latest_predictions(parts, ("trade_date", "entity_code", *keys)).withColumn("prediction", F.col("score"))
    return metrics(latest.where("prediction is not null").join(labels.where("label is not null"), ["trade_date", "entity_code"]), keys)


def class_metrics(df: DataFrame, keys: list[str]) -> DataFrame:
    """df (keys, probability, label 0/1) -> auc (ties half), log_loss, accuracy, precision, recall, f1, positive_rate.

    The AUC comes from counts per distinct probability; ranges of probabilities are put in order apart.
    """
    p = F.greatest(F.lit(1e-7), F.least(F.lit(1 - 1e-7), F.col("probability")))
    y, hit = F.col("label"), (F.col("probability") >= 0.5).cast("int")
    s = df.groupBy(*keys).agg(
        F.count("*").alias("rows"), F.avg(-F.when(y == 1, F.log(p)).otherwise(F.log(1 - p))).alias("log_loss"), F.avg((hit == y).cast("double")).alias("accuracy"),
        F.sum(hit * y).alias("__tp"), F.sum(hit).alias("__pp"), F.sum(y).alias("__p"),
    )
    won = ordered.wins(df, "probability", y, 1 - y, keys)
    wins = won.select(*keys, (F.col("wins") / F.nullif(F.col("na") * F.col("nb"), F.lit(0))).alias("auc"))
    met = s.join(wins, keys)
    precision, recall = F.try_divide("__tp", "__pp"), F.try_divide("__tp", "__p")
    return met.select(*keys, "rows", "auc", "log_loss", "accuracy", precision.alias("precision"), recall.alias("recall"), F.try_divide(2 * F.col("__tp"), F.col("__pp") + F.col("__p")).alias("f1"), (F.col("__p") / F.col("rows")).alias("positive_rate"))


def select_trial(trials: DataFrame, days: int = 40, ic: float = 0.02, icir: float = 0.3) -> DataFrame:
    """trials (trial, days, ic, icir, rmse) of validation: the best that is good enough, by ic, icir, rmse, number."""
    good = trials.where((F.col("days") >= days) & (F.col("ic") >= ic) & (F.col("icir") >= icir))
    return good.orderBy(F.col("ic").desc(), F.col("icir").desc(), "rmse", "trial").limit(1)


def parameter_effects(trials: DataFrame, metric: str = "ic") -> DataFrame:
    """trials (trial, params map, metric) -> per parameter and value: n, mean, std, least, most, best, spread of means."""
    long = trials.select(F.explode("params").alias("parameter", "value"), F.col(metric).alias("m"))
    s = long.groupBy("parameter", "value").agg(F.count("m").alias("n"), F.avg("m").alias("mean"), F.stddev_samp("m").alias("std"), F.min("m").alias("least"), F.max("m").alias("most"))
    own = Window.partitionBy("parameter")
    return s.withColumns({"best": (F.row_number().over(own.orderBy(F.col("mean").desc(), "value")) == 1).cast("int"), "spread": F.max("mean").over(own) - F.min("mean").over(own)})


#: The rules of the research gate and of walk-forward stability, (metric, operator, bound).
RESEARCH_RULES = (
    ("validation_days", ">=", 40),
    ("validation_rank_ic", ">=", 0.02),
    ("validation_ic_ir", ">=", 0.30),
    ("test_days", ">=", 40),
    ("test_rank_ic", ">=", 0.02),
    ("test_ic_ir", ">=", 0.30),
    ("trading_days", ">=", 40),
    ("excess_annual_return", ">", 0.0),
    ("sharpe_ratio", ">", 0.0),
    ("max_drawdown", ">=", -0.30),
)
STABILITY_RULES = (
    ("window_count", ">=", 3),
    ("window_ic_mean", ">=", 0.02),
    ("window_ic_std", "<=", 0.02),
    ("positive_ic_window_ratio", ">=", 0.50),
    ("ic_ir", ">=", 0.30),
)
_HOLDS = {">=": Column.__ge__, ">": Column.__gt__, "<=": Column.__le__, "<": Column.__lt__}


def gate(long: DataFrame, rules: tuple[tuple[str, str, float], ...] = RESEARCH_RULES, key: str = "id") -> DataFrame:
    """long (key, metric, value) -> (key, passed, held, failed): every rule must hold; a missing metric fails its rule."""
    value = lambda m: F.max(F.when(F.col("metric") == m, F.col("value")))
    wide = long.groupBy(key).agg(*[value(m).alias(m) for m, _, _ in rules])
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(_HOLDS[op](F.col(m), F.lit(float(bound))), F.lit(False)), m) for m, op, bound in rules]))
    return wide.select(key, (F.size(failed) == 0).cast("int").alias("passed"), (len(rules) - F.size(failed)).alias("held"), failed.alias("failed"))


def stability_gate(windows: DataFrame, stitched: DataFrame, key: str = "id") -> DataFrame:
    """windows (key, window, rank_ic), stitched (key, ic_ir of all windows in one) -> gate by STABILITY_RULES, with status."""
    ic = F.col("rank_ic")
    s = windows.groupBy(key).agg(F.count(ic).cast("double").alias("window_count"), F.avg(ic).alias("window_ic_mean"), F.stddev_pop(ic).alias("window_ic_std"), F.avg((ic > 0).cast("double")).alias("positive_ic_window_ratio"))
    long = s.join(stitched.select(key, "ic_ir"), key, "left").unpivot([key], [m for m, _, _ in STABILITY_RULES], "metric", "value")
    few = F.array_contains("failed", "window_count")
    status = F.when(few, "insufficient_windows").when(F.col("passed") == 1, "stable").when(F.col("held") >= 3, "mixed").otherwise("unstable")
    return gate(long, STABILITY_RULES, key).withColumn("status", status)


def leaderboard(models: DataFrame, cohort: list[str]) -> DataFrame:
    """models (model_id, cohort columns, ic, icir): rank within the same cohort by ic, then icir; null ic is unranked."""
    key = F.sha2(F.to_json(F.struct(*cohort)), 256)  # named values, nulls left out: no two cohorts share a text
    own = Window.partitionBy("cohort").orderBy(F.col("ic").desc_nulls_last(), F.col("icir").desc_nulls_last(), "model_id")
    return models.withColumn("cohort", key).withColumn("place", F.when(F.col("ic").isNotNull(), F.row_number().over(own)))


def ensemble(predictions: DataFrame, sources: DataFrame) -> DataFrame:
    """predictions (trade_date, entity_code, model_id, score), sources (model_id, weight) -> combined scores.

    Only entities that all sources cover count. Weighted scores are added in the order of model_id, so one sum has one
    value; ranks count it in units of 1e-12 (floor(score * 1e12 + 0.5)), ties by code. Ranks are unique, the percentile is
    (rank - 1) / (n - 1).
    """
    counted = sources.withColumn("__of", F.count(F.lit(1)).over(Window.partitionBy()))  # a row per model
    met = predictions.join(counted, "model_id").groupBy("trade_date", "entity_code").agg(F.array_sort(F.collect_list(F.struct("model_id", "weight", "score"))).alias("__s"), F.first("__of").alias("__of"))
    total = lambda term: F.aggregate("__s", F.lit(0.0), lambda a, v: a + F.coalesce(term(v), F.lit(0.0)))
    whole = met.where(F.size(F.array_distinct(F.col("__s.model_id"))) == F.col("__of"))
    mean = F.when(F.exists("__s", lambda v: v["score"].isNotNull()), total(lambda v: v["weight"] * v["score"]) / total(lambda v: v["weight"]))
    whole = whole.select("trade_date", "entity_code", mean.alias("score"))
    units = F.floor(F.col("score") * 1e12 + 0.5) / 1e12
    whole = whole.withColumn("score", F.when(F.abs("score") < 9e3, units).otherwise(F.col("score")))  # larger ones have no such places
    n = F.count(F.lit(1)).over(x.xs())
    ranked = whole.withColumns({"rank_value": x.rank_first("score"), "__n": n})
    return ranked.withColumn("percentile", F.when(F.col("__n") > 1, (F.col("rank_value") - 1) / (F.col("__n") - 1)).otherwise(0.0)).drop("__n")


# --- distributions ---


def psi(df: DataFrame, value: str, side: str, reference: str, bins: int = 10, keys: tuple[str, ...] = (), eps: float = 1e-6) -> DataFrame:
    """Population stability of the other sides of a column against its reference side: (keys, side, psi).

    Edges are the distinct quantiles of the reference between its ends, outer bins open; a constant reference has three
    bins: below, about (a relative tolerance of 1e-9), and above it.
    """
    have = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    points = [i / bins for i in range(bins + 1)]
    all_ = ordered.exact_quantiles(have.where(F.col(side) == reference), value, points, list(keys)).select(*keys, F.array_distinct("q").alias("__q"))
    centre = F.col("__q")[0]
    tolerance = F.greatest(F.abs(centre) * 1e-9, F.lit(1e-9))
    inner = F.when(F.size("__q") == 1, F.array(centre - tolerance, centre + tolerance)).otherwise(F.slice("__q", F.lit(2), F.greatest(F.size("__q") - 2, F.lit(0))))
    cuts = all_.select(*keys, inner.alias("__cuts"))
    met = ordered.met(have, ordered.stored(cuts), list(keys))
    binned = met.withColumn("__bin", F.size(F.filter("__cuts", lambda e: F.col(value) >= e))).groupBy(*keys, side, "__bin").agg(F.count("*").alias("n"))
    share = binned.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy(*keys, side)))
    ref = share.where(F.col(side) == reference).select(*keys, "__bin", F.col("p").alias("r"))
    sides = share.where(F.col(side) != reference).select(*keys, side).distinct()
    grid = share.select(*keys, "__bin").distinct()
    grid = grid.join(sides, list(keys)) if keys else grid.crossJoin(sides)
    full = grid.join(share.select(*keys, side, "__bin", "p"), [*keys, side, "__bin"], "left").join(ref, [*keys, "__bin"], "left")
    p, r = (F.greatest(F.coalesce(c, F.lit(0.0)), F.lit(eps)) for c in ("p", "r"))
    return full.groupBy(*keys, side).agg(F.sum((p - r) * F.log(p / r)).alias("psi"))


def ks(df: DataFrame, value: str, side: str, a: str, b: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Largest gap between two empirical distributions: (keys, ks). Ranges of values are put in order apart."""
    return ordered.gaps(df.where(F.col(side).isin(a, b)), value, F.col(side) == a, F.col(side) == b, list(keys)).withColumnRenamed("gap", "ks")


def feature_drift(df: DataFrame, names: list[str], split: str = "split", warn: float = 0.10, bad: float = 0.25) -> DataFrame:
    """Per feature train against test: psi, ks, missing shares, means, deviations, medians, status.

    A feature without a psi, as one that a side lacks, counts as severe.
    """
    long = df.unpivot([split], names, "feature", "v")
    stats = long.where(F.col(split).isin("train", "test")).groupBy("feature", split).agg(F.avg(F.col("v").isNull().cast("double")).alias("missing"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"))
    middle = ordered.exact_quantiles(long.where(F.col(split).isin("train", "test")), "v", [0.5], ["feature", split]).select("feature", split, F.col("q")[0].alias("median"))
    stats = stats.join(middle, ["feature", split], "left")
    a, b = (stats.where(F.col(split) == s).select("feature", *[F.col(c).alias(f"{s}_{c}") for c in ("missing", "mean", "std", "median")]) for s in ("train", "test"))
    p = psi(long, "v", split, "train", keys=("feature",)).where(F.col(split) == "test").select("feature", "psi")
    out = a.join(b, "feature", "full_outer").join(p, "feature", "left").join(ks(long, "v", split, "train", "test", ("feature",)), "feature", "left")
    return out.withColumn("status", F.when(F.col("psi").isNull() | (F.col("psi") >= bad), "severe").when(F.col("psi") >= warn, "medium").otherwise("stable"))


def reproducibility(a: DataFrame, b: DataFrame, on: list[str], value: str = "score") -> DataFrame:
    """Two runs of one prediction: keys, largest difference, correlation, identical share, and what that amounts to."""
    met = a.select(*on, F.col(value).alias("x")).join(b.select(*on, F.col(value).alias("y")), on, "full_outer")
    gap = F.abs(F.col("x") - F.col("y"))
    s = met.agg(F.count(F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), 1)).alias("common"), F.count(F.when(F.col("y").isNull(), 1)).alias("left_only"), F.count(F.when(F.col("x").isNull(), 1)).alias("right_only"), F.max(gap).alias("max_delta"), F.avg((gap <= 1e-12).cast("double")).alias("identical"), F.covar_pop("x", "y").alias("__c"), (F.stddev_pop(F.when(F.col("y").isNotNull(), F.col("x"))) * F.stddev_pop(F.when(F.col("x").isNotNull(), F.col("y")))).alias("__s"))
    whole = (F.col("left_only") == 0) & (F.col("right_only") == 0)
    status = F.when(whole & (F.col("max_delta") <= 1e-12), "exact").when(whole & (F.col("max_delta") <= 1e-6), "equivalent").otherwise("drifted")
    return s.withColumn("pearson", _ratio(F.col("__c"), F.col("__s"))).withColumn("status", status).drop("__c", "__s")


def metric_diff(a: DataFrame, b: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """(path, left_value, right_value, equal) of two long metric tables (path, value)."""
    met = a.select("path", F.col("value").alias("left_value")).join(b.select("path", F.col("value").alias("right_value")), "path", "full_outer")
    return met.withColumn("equal", F.coalesce((F.abs(F.col("left_value") - F.col("right_value")) <= tolerance), F.lit(False)).cast("int"))
