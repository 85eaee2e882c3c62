"""Queries of sinks, training and refresh: each writes to the shared scratch folder and returns what is read back."""

from pyspark.sql import functions as F

from ..functions import catalog
from ..operators import datasets as d
from ..plans import factor_job as job
from ..plans import training as t
from ..sources import manifest, sinks
from ..streaming.refresh import incremental_refresh, refresh_batch
from .base import Registry, panel
from .cross import _JOB, CATALOG_SQL
from .cross import _WINDOWS as WINDOWS
from .evaluation import PRED, predictions, prices
from .models import LAB
from .sources import cal

R = Registry()
K = "entity_code trade_date"
c = F.col
NAMES = ["BIAS5", "VROC6", "PSY"]


@R.add("s_supersede", K + " job_id", "raw_value", sql=f"""
SELECT entity_code, trade_date, CASE WHEN trade_date < DATE '1998-01-01' THEN 'old' ELSE 'new' END AS job_id, raw_value FROM ({_JOB})""")
def _(spark, sf):
    """An old job over the whole range, then a new one over its later half, which replaces it there."""
    return spark.read.parquet(_two_jobs(spark, sf))


def _two_jobs(spark, sf):
    path, p = sinks.scratch(spark, "values"), panel(spark, sf)
    make = lambda x: x.withColumn("raw_value", catalog.r.period_return(c("close"), 4))
    for name, start in (("old", "1996-01-01"), ("new", "1998-01-01")):
        incremental_refresh(spark, p, make, 52, path, "drift", name, start, "1999-12-31")
    return path


@R.add("s_predictions", "trade_date entity_code model_id", "score", sql=f"WITH {PRED} SELECT trade_date, entity_code, engine AS model_id, score FROM pred UNION ALL SELECT trade_date, entity_code, engine, score FROM pred WHERE engine = 'a'")
def _(spark, sf):
    path = sinks.scratch(spark, "predictions")
    rows = predictions(spark, sf).select("trade_date", "entity_code", c("engine").alias("model_id"), F.lit(1).alias("model_version"), c("score").alias("raw_prediction"), "score")
    sinks.write_predictions(rows, path)
    sinks.append_predictions(rows.where("model_id = 'a'").withColumn("model_version", F.lit(2)), f"{path}/training")
    return spark.read.parquet(f"{path}/training")


def dataset(spark, sf):
    members = panel(spark, sf).select("entity_code", "trade_date")
    features = job.feature_matrix(members, panel(spark, sf), NAMES, 0.5)
    path = sinks.scratch(spark, "dataset")  # built once, read by every fit
    d.build_dataset(features, d.rank_label(prices(spark, sf), cal(spark, sf), 4), NAMES)[0].write.parquet(path)
    return spark.read.parquet(path)


_F = {n: CATALOG_SQL[g][n] for g, n in (("momentum", "BIAS5"), ("sentiment", "VROC6"), ("sentiment", "PSY"))}
FEATURES = f"""q0 AS (SELECT entity_code, trade_date, {", ".join(f"{e} AS {n}" for n, e in _F.items())} FROM panel {WINDOWS}),
q1 AS (SELECT entity_code, trade_date, {", ".join(f"CASE WHEN isfinite({n}) THEN {n} END AS {n}" for n in _F)} FROM q0),
feat AS (SELECT entity_code, trade_date, {", ".join(f"CASE WHEN {n} IS NOT NULL THEN CASE WHEN stddev_pop({n}) OVER d > 0 THEN ({n} - avg({n}) OVER d) / stddev_pop({n}) OVER d ELSE 0 END END AS {n}" for n in _F)} FROM q1 WINDOW d AS (PARTITION BY trade_date))"""
ROWS = f"""{LAB}, {FEATURES}, fl AS (SELECT feat.*, lb.label FROM feat JOIN lb USING (entity_code, trade_date)),
td AS (SELECT trade_date, row_number() OVER (ORDER BY trade_date) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT trade_date FROM fl)),
sd AS (SELECT trade_date, CASE WHEN i < floor(n * 0.6::DOUBLE) - 5 THEN 'train' WHEN i >= floor(n * 0.6::DOUBLE) AND i < floor(n * 0.8::DOUBLE) - 5 THEN 'valid' WHEN i >= floor(n * 0.8::DOUBLE) THEN 'test' END AS split FROM td),
dr AS (SELECT * FROM fl JOIN sd USING (trade_date) WHERE split IS NOT NULL), md AS (SELECT {", ".join(f"coalesce(quantile_cont({n}, 0.5) FILTER (split = 'train'), 0) AS m_{n}" for n in _F)} FROM dr)"""


@R.add("s_snapshot", K + " split copy", "label BIAS5 VROC6 PSY", sql=f"""
WITH {ROWS} SELECT entity_code, trade_date, split, 'raw' AS copy, label, BIAS5, VROC6, PSY FROM dr
UNION ALL SELECT entity_code, trade_date, split, 'imputed', label, {", ".join(f"coalesce({n}, m_{n}) AS {n}" for n in _F)} FROM dr, md""")
def _(spark, sf):
    """Raw and imputed rows under one name; asked for again, they are read back and checked."""
    path, copies = sinks.scratch(spark, "snapshots"), {}
    members = panel(spark, sf).select("entity_code", "trade_date")
    raw = sinks.stored(d.dataset_rows(job.feature_matrix(members, panel(spark, sf), NAMES, 0.5), d.rank_label(prices(spark, sf), cal(spark, sf), 4)))
    pair = {"raw": raw, "imputed": d.impute(raw, d.fit_medians(raw.where("split = 'train'"), NAMES), NAMES)}
    for _ in range(2):
        copies = sinks.snapshot_of(pair, "d1", path, c("split"))
    cols = ["entity_code", "trade_date", "split", "label", *NAMES]
    return copies["raw"].select(*cols, F.lit("raw").alias("copy")).unionByName(copies["imputed"].select(*cols, F.lit("imputed").alias("copy")))


@R.add("s_manifest", "factor_id first_date last_date", "", "rows", sql=f"SELECT 'drift' AS factor_id, min(trade_date) AS first_date, max(trade_date) AS last_date, count(*) AS rows FROM ({_JOB})")
def _(spark, sf):
    """What the manifest says of two jobs' values, one of which replaced half of the other's."""
    return manifest.latest_dates(spark, _two_jobs(spark, sf))


@R.add("t_stream_refresh", K, "raw_value processed score", "rank_value", sql=_JOB)
def _(spark, sf):
    """Trades arrive as files, a year or more at a time; each batch computes its dates anew over all trades."""
    make = lambda x: x.withColumn("raw_value", catalog.r.period_return(c("close"), 4))
    arriving, path, p = sinks.scratch(spark, "arriving"), sinks.scratch(spark, "values"), sinks.stored(panel(spark, sf))
    dated = p.select("trade_date").where(c("trade_date").between("1996-01-01", "1999-12-31"))
    dated.repartitionByRange(4, "trade_date").write.parquet(arriving)
    step = refresh_batch(lambda s: p, make, 52, path, "drift")
    stream = spark.readStream.schema(dated.schema).option("maxFilesPerTrigger", 1).parquet(arriving)
    query = stream.writeStream.foreachBatch(step).option("checkpointLocation", sinks.scratch(spark, "offsets")).trigger(availableNow=True).start()
    query.awaitTermination()
    return manifest.read_values(spark, path)


@R.add("s_replace", "trade_date entity_code engine", "score", sql=f"WITH {PRED} SELECT trade_date, entity_code, engine, CASE WHEN engine = 'b' THEN -score ELSE score END AS score FROM pred")
def _(spark, sf):
    path, p = sinks.scratch(spark, "results"), predictions(spark, sf)
    sinks.replace_by_key(p, path, "engine")
    sinks.replace_by_key(p.where("engine = 'b'").withColumn("score", -c("score")), path, "engine")
    return spark.read.parquet(path)


def _fit(kind: str, target: str = "regression"):
    @R.add(f"m_{kind}_{target}", K, "raw_prediction score", "rank_value", share=True)
    def _(spark, sf):
        rows = dataset(spark, sf)
        if target == "binary":
            rows = rows.withColumn("label", (c("label") > 0).cast("int"))
        model = t.fit(rows, NAMES, kind, target)
        return t.prediction_frame(t.predict(model, rows.where("split = 'test'")).select("entity_code", "trade_date", "raw_prediction"))


for _kind in ("linear", "random_forest", "gbt"):
    _fit(_kind)
_fit("linear", "binary")
_fit("mlp", "binary")


@R.add("m_walk_forward", K, "raw_prediction", "fold", share=True)
def _(spark, sf):
    rows = dataset(spark, sf)
    days = [r[0] for r in rows.select("trade_date").distinct().orderBy("trade_date").collect()]  # a row per session
    return t.walk_forward_fit(rows, d.walk_forward(days, spark, 150, 21, gap=5), NAMES).withColumnRenamed("window", "fold")


@R.add("m_permutation", "feature", "ic drop", share=True)
def _(spark, sf):
    rows = dataset(spark, sf)
    return t.permutation_importance(t.fit(rows, NAMES), rows.where("split = 'valid'"), NAMES)


@R.add("m_trials", "", "ic icir rmse", "trial days rows", share=True)
def _(spark, sf):
    return t.trials(dataset(spark, sf), NAMES, t.grid(regParam=[0.001, 0.1], without=[[], ["PSY"]]))


@R.add("d_features", K, "BIAS5 VROC6 PSY", sql=f"WITH {LAB}, {FEATURES} SELECT * FROM feat")
def _(spark, sf):
    p = panel(spark, sf)
    return job.feature_matrix(p.select("entity_code", "trade_date"), p, NAMES, 0.5)


@R.add("m_score_day", K, "raw_prediction score percentile", "rank_value", share=True)
def _(spark, sf):
    rows = dataset(spark, sf)
    last = rows.agg(F.max("trade_date")).first()[0]
    return t.score_day(t.fit(rows, NAMES), rows, str(last))


@R.add("m_importance", "feature", "importance", "place", share=True)
def _(spark, sf):
    return t.importance(t.fit(dataset(spark, sf), NAMES, "random_forest"), NAMES, spark)
