"""Training and scoring with Spark ML: pipelines over flat feature columns."""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.datasets import fit_medians
from ..operators.evaluate import rank_corr
from ..operators.metrics import metrics, prediction_frame
from ..sources.sinks import stored
from . import linear

SEED = 7
#: Penalty of linear regressions unless another is given.
RIDGE = 0.01


def estimator(kind: str, target: str, n_features: int, **params):
    """kind: linear, random_forest, gbt or (binary only) mlp. target: regression or binary."""
    binary = target == "binary"
    if kind == "linear":
        return LogisticRegression(labelCol="label", **params) if binary else LinearRegression(labelCol="label", elasticNetParam=0.0, **({"regParam": RIDGE} | params))
    if kind == "random_forest":
        make = RandomForestClassifier if binary else RandomForestRegressor
        return make(labelCol="label", seed=SEED, **({"numTrees": 20, "maxDepth": 5} | params))
    if kind == "gbt":
        make = GBTClassifier if binary else GBTRegressor
        return make(labelCol="label", seed=SEED, validationIndicatorCol="is_valid", **({"maxIter": 20, "maxDepth": 4} | params))
    if kind == "mlp" and binary:
        return MultilayerPerceptronClassifier(labelCol="label", seed=SEED, layers=[n_features, 8, 2], **({"maxIter": 30} | params))
    raise ValueError(f"no {kind} for {target}")


def fit(dataset: DataFrame, names: list[str], kind: str = "linear", target: str = "regression", **params) -> PipelineModel:
    """dataset (names, label, split): medians of the training rows fill gaps; boosted trees stop early on valid rows."""
    rows = dataset.where(F.col("split").isin("train", "valid") if kind == "gbt" else F.col("split") == "train")
    rows = rows.where("label is not null").withColumns({"label": F.col("label").cast("double"), "is_valid": F.col("split") == "valid"})
    # The median of the one row of medians is that row: the Imputer itself would gather each column in one place.
    fill = Imputer(strategy="median", relativeError=0.0, inputCols=names, outputCols=[f"{n}__f" for n in names]).fit(fit_medians(rows, names))
    assemble = VectorAssembler(inputCols=[f"{n}__f" for n in names], outputCol="features")
    return Pipeline(stages=[fill, assemble, estimator(kind, target, len(names), **params)]).fit(rows)


def predict(model: PipelineModel, df: DataFrame) -> DataFrame:
    """df with raw_prediction: the prediction, or the probability of class 1."""
    out = model.transform(df)
    raw = vector_to_array("probability")[1] if "probability" in out.columns else F.col("prediction")
    return out.withColumn("raw_prediction", raw).select(*df.columns, "raw_prediction")


def walk_forward_fit(dataset: DataFrame, windows: DataFrame, names: list[str], kind: str = "linear") -> DataFrame:
    """Out-of-sample predictions of all windows (window, split, start_date, end_date), each fitted on its own training rows.

    Linear models of all windows come from one pass (see linear); of other kinds there is a fit per window, and they are few.
    Predictions of one entity and date from two windows are an error.
    """
    if kind == "linear":
        return _walk_forward_linear(dataset.drop("split"), windows, names)
    parts = []
    for w in sorted({r["window"] for r in windows.select("window").distinct().collect()}):
        spans = windows.where(F.col("window") == w).select("split", "start_date", "end_date")
        rows = dataset.drop("split").join(spans.select("split", F.explode(F.sequence("start_date", "end_date")).alias("trade_date")), "trade_date")
        model = fit(rows, names, kind)
        parts.append(predict(model, rows.where("split = 'test'")).withColumn("window", F.lit(w)))
    return _once_each(reduce(DataFrame.unionByName, parts))


def _once_each(out: DataFrame) -> DataFrame:
    if out.groupBy("trade_date", "entity_code").count().where("count > 1").take(1):
        raise ValueError("windows overlap")
    return out


def _walk_forward_linear(rows: DataFrame, windows: DataFrame, names: list[str]) -> DataFrame:
    own = linear.models(linear.blocks(rows, names), windows, [{"regParam": RIDGE}]).select("window", "intercept", "coefficients")
    tested = windows.where("split = 'test'").select("window", "split", F.explode(F.sequence("start_date", "end_date")).alias("trade_date"))
    met = rows.join(F.broadcast(tested.join(own, "window")), "trade_date")  # a row per tested date
    out = met.withColumn("raw_prediction", linear.predicted(names, F.col("intercept"), F.col("coefficients")))
    return _once_each(out.select(*rows.columns, "split", "raw_prediction", "window"))


def score_day(model: PipelineModel, features: DataFrame, day: str, scope: str = "stock") -> DataFrame:
    """Ranked predictions of one day."""
    rows = features.where(F.col("trade_date") == F.lit(day).cast("date"))
    return prediction_frame(predict(model, rows).select("entity_code", "trade_date", "raw_prediction"), scope)


def importance(model: PipelineModel, names: list[str], spark) -> DataFrame:
    """(feature, importance, place): of trees, or absolute coefficients."""
    last = model.stages[-1]
    values = last.featureImportances.toArray() if hasattr(last, "featureImportances") else abs(last.coefficients.toArray())
    rows = sorted(zip(names, map(float, values), strict=True), key=lambda x: (-x[1], x[0]))
    return spark.createDataFrame([(n, v, i) for i, (n, v) in enumerate(rows, 1)], "feature string, importance double, place int")


def permutation_importance(model: PipelineModel, df: DataFrame, names: list[str]) -> DataFrame:
    """(feature, ic, drop): mean daily IC after one feature is shuffled within its dates, and what that costs.

    The shuffle pairs each row with the row at its place in hash order of the same date; all features are scored in one
    pass, keyed by feature.
    """
    day = Window.partitionBy("trade_date")
    placed = df.where("label is not null").withColumns({"__i": F.row_number().over(day.orderBy("entity_code")), "__j": F.row_number().over(day.orderBy(F.xxhash64("entity_code", F.lit(SEED)), "entity_code"))})
    other = placed.select("trade_date", F.col("__j").alias("__i"), *[F.col(n).alias(f"__{n}") for n in names])
    met = placed.join(other, ["trade_date", "__i"]).withColumn("feature", F.explode(F.array(F.lit(None).cast("string"), *map(F.lit, names))))
    shuffled = [F.when(F.col("feature") == n, F.col(f"__{n}")).otherwise(F.col(n)).alias(n) for n in names]
    rows = met.select(F.coalesce("feature", F.lit("")).alias("feature"), "trade_date", "entity_code", "label", *shuffled)
    daily = rank_corr(predict(model, rows), ["feature", "trade_date"], "raw_prediction", "label")
    ic = daily.groupBy("feature").agg(F.avg("ic").alias("ic"))
    base = F.max(F.when(F.col("feature") == "", F.col("ic"))).over(Window.partitionBy())  # a row per feature
    return ic.withColumn("base", base).where("feature <> ''").select("feature", "ic", (F.col("base") - F.col("ic")).alias("drop"))


def grid(**values: list) -> list[dict]:
    """Every combination of the values, in the order of the arguments."""
    return [dict(zip(values, combination, strict=True)) for combination in product(*values.values())]


def trials(dataset: DataFrame, names: list[str], params: list[dict], kind: str = "linear") -> DataFrame:
    """A fit per entry over the stored dataset; validation metrics as (trial, params, ic, icir, days, rmse).

    An entry may leave features out under `without`, a list of names. Linear trials that set nothing but that and regParam
    come from one pass, and are scored in one.
    """
    rows = stored(dataset)
    valid = rows.where("split = 'valid' and label is not null")
    pairs = lambda one: [x for k, v in one.items() for x in (F.lit(k), F.lit(str(v)))]
    as_map = lambda one: F.create_map(*pairs(one)) if one else F.create_map().cast("map<string,string>")
    if kind == "linear" and all(set(one) <= {"regParam", "without"} for one in params):
        own = linear.blocks(rows.where("split = 'train'"), names)
        span = own.table.agg(F.lit(1).alias("window"), F.lit("train").alias("split"), F.min("trade_date").alias("start_date"), F.max("trade_date").alias("end_date"))
        found = linear.models(own, span, [{"regParam": RIDGE} | one for one in params]).orderBy("variant").collect()  # a row per trial
        each = F.array(*[F.struct(F.lit(r["variant"]).alias("trial"), linear.predicted(names, F.lit(r["intercept"]), F.array(*map(F.lit, r["coefficients"]))).alias("prediction")) for r in found])
        scored = valid.select("trade_date", "entity_code", "label", F.explode(each).alias("s")).select("trade_date", "entity_code", "label", "s.*")
        return metrics(scored, ["trial"]).withColumn("params", F.element_at(F.array(*map(as_map, params)), F.col("trial")))
    parts = []
    for i, one in enumerate(params, 1):
        kept = [n for n in names if n not in one.get("without", ())]
        model = fit(rows, kept, kind, **{k: v for k, v in one.items() if k != "without"})
        scored = predict(model, valid)
        own = metrics(scored.withColumnRenamed("raw_prediction", "prediction").withColumn("trial", F.lit(i)), ["trial"])
        parts.append(own.withColumn("params", as_map(one)))
    return reduce(DataFrame.unionByName, parts)
