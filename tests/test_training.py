"""Linear models from blocks, and the other models, against brute force and known answers."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from alphaloom.plans import linear, training

NAMES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    n = 1500
    x = rng.normal(size=(n, 3)) * [1, 10, 0.1] + [0, 1000, 5]
    y = 0.3 * x[:, 0] - 0.02 * x[:, 1] + 2 * x[:, 2] + rng.normal(size=n)
    day = np.arange(n) % 60
    return x, y, day


@pytest.fixture(scope="module")
def dataset(spark, rows):
    x, y, day = rows
    split = lambda d: "train" if d < 36 else "valid" if d < 48 else "test"
    made = [(f"e{i}", dt.date(2020, 1, 1) + dt.timedelta(int(d)), *map(float, v), float(t), split(d)) for i, (v, t, d) in enumerate(zip(x, y, day, strict=True))]
    return spark.createDataFrame(made, "entity_code string, trade_date date, a double, b double, c double, label double, split string").repartition(5)


def ridge_plainly(x, y, penalty):
    xc, yc = x - x.mean(0), y - y.mean()
    a = xc.T @ xc / len(x) + np.diag(penalty / y.std() * x.var(0))
    w = np.linalg.solve(a, xc.T @ yc / len(x))
    return y.mean() - w @ x.mean(0), w


def windows(spark):
    day = lambda i: dt.date(2020, 1, 1) + dt.timedelta(i)
    spans = [(1, "train", day(0), day(19)), (1, "test", day(20), day(29)), (2, "train", day(10), day(29)), (2, "test", day(30), day(45))]
    return spark.createDataFrame(spans, "window int, split string, start_date date, end_date date")


def test_blocks_of_windows_and_left_out_features(spark, dataset, rows):
    x, y, day = rows
    own = linear.blocks(dataset, NAMES)
    got = {(r["window"], r["variant"]): r for r in linear.models(own, windows(spark), [{"regParam": 0.0}, {"regParam": 0.1, "without": ["b"]}]).collect()}
    for w, (lo, hi) in {1: (0, 19), 2: (10, 29)}.items():
        s = (day >= lo) & (day <= hi)
        b0, b = ridge_plainly(x[s], y[s], 0.0)
        assert np.allclose(got[w, 1]["coefficients"], b, rtol=1e-8) and got[w, 1]["intercept"] == pytest.approx(b0, rel=1e-7)
        b0, b = ridge_plainly(x[s][:, [0, 2]], y[s], 0.1)
        assert np.allclose(got[w, 2]["coefficients"], [b[0], 0, b[1]], rtol=1e-8) and got[w, 2]["intercept"] == pytest.approx(b0, rel=1e-7)


def test_blocks_are_those_of_spark_ml(dataset, rows):
    x, y, day = rows
    model = training.fit(dataset, NAMES).stages[-1]
    b0, b = ridge_plainly(x[day < 36], y[day < 36], training.RIDGE)
    assert np.allclose(model.coefficients.toArray(), b, rtol=1e-6) and model.intercept == pytest.approx(b0, rel=1e-6)


def test_walk_forward_predictions(spark, dataset, rows):
    x, y, day = rows
    got = {r["entity_code"]: r for r in training.walk_forward_fit(dataset, windows(spark), NAMES).collect()}
    assert len(got) == int(((day >= 20) & (day <= 45)).sum())
    for i in range(len(y)):
        if 20 <= day[i] <= 45:
            s = (day <= 19) if day[i] < 30 else (day >= 10) & (day <= 29)
            b0, b = ridge_plainly(x[s], y[s], training.RIDGE)
            assert got[f"e{i}"]["raw_prediction"] == pytest.approx(b0 + x[i] @ b, abs=1e-6)


def test_odd_rows_of_blocks(spark):
    made = [("2020-01-01", 1.0, 2.0, 3.0), ("2020-01-01", None, 1.0, 1.0), ("2020-01-02", float("nan"), 1.0, 1.0), ("2020-01-02", 2.0, 2.0, None), ("2020-01-03", 3.0, 2.0, 7.0)]
    df = spark.createDataFrame(made, "trade_date string, a double, b double, label double")
    own = linear.blocks(df, ["a", "b"])
    assert sorted((str(r["trade_date"]), r["n"]) for r in own.table.collect()) == [("2020-01-01", 1), ("2020-01-03", 1)]
    span = spark.createDataFrame([(1, "train", dt.date(2020, 1, 1), dt.date(2020, 1, 3))], "window int, split string, start_date date, end_date date")
    r = linear.models(own, span, [{}]).first()
    assert r["coefficients"] == pytest.approx([2.0, 0.0]) and r["intercept"] == pytest.approx(1.0)
    assert linear.blocks(df.limit(0), ["a"]).table.count() == 0


def test_trials_agree_with_a_fit_each(dataset):
    params = training.grid(regParam=[0.001, 5.0], without=[[], ["b"]])
    fast = {r["trial"]: r for r in training.trials(dataset, NAMES, params).collect()}
    slow = {r["trial"]: r for r in training.trials(dataset, NAMES, [p | {"maxIter": 100} for p in params]).collect()}
    assert set(fast) == set(slow) == {1, 2, 3, 4}
    for i in fast:
        assert fast[i]["rmse"] == pytest.approx(slow[i]["rmse"], rel=1e-6) and fast[i]["ic"] == pytest.approx(slow[i]["ic"], abs=1e-6)
        assert fast[i]["params"]["regParam"] == slow[i]["params"]["regParam"]


def test_permutation_importance(dataset, rows):
    """What is shuffled is known, so the drop of each feature can be computed."""
    model = training.fit(dataset, NAMES)
    got = {r["feature"]: r for r in training.permutation_importance(model, dataset, NAMES).collect()}
    assert set(got) == set(NAMES) and all(-1 <= r["ic"] <= 1 for r in got.values())
    assert got["a"]["drop"] > 0 and got["b"]["drop"] > 0
    base = {r["feature"]: r["ic"] + r["drop"] for r in got.values()}
    assert max(base.values()) - min(base.values()) < 1e-12


@pytest.mark.parametrize("kind", ["random_forest", "gbt"])
def test_trees_learn_a_step(spark, kind):
    rng = np.random.default_rng(1)
    made = [(f"e{i}", dt.date(2020, 1, 1), float(v), float(u), float(v > 0.5), "train" if i % 4 else "valid") for i, (v, u) in enumerate(rng.random((800, 2)))]
    df = spark.createDataFrame(made, "entity_code string, trade_date date, a double, b double, label double, split string")
    model = training.fit(df, ["a", "b"], kind)
    got = training.predict(model, df).select("a", "raw_prediction").collect()
    wrong = [r for r in got if abs(r["a"] - 0.5) > 0.05 and abs(r["raw_prediction"] - (r["a"] > 0.5)) > 0.25]
    assert not wrong
    first = training.importance(model, ["a", "b"], spark).orderBy("place").first()
    assert first["feature"] == "a" and first["importance"] > 0.8


@pytest.mark.parametrize("kind", ["linear", "mlp"])
def test_classes_are_told_apart(spark, kind):
    rng = np.random.default_rng(2)
    made = [(f"e{i}", dt.date(2020, 1, 1 + i % 2), float(v), float(u), int(v + u > 0), "train") for i, (v, u) in enumerate(rng.normal(size=(600, 2)))]
    df = spark.createDataFrame(made, "entity_code string, trade_date date, a double, b double, label int, split string")
    model = training.fit(df, ["a", "b"], kind, "binary")
    got = training.predict(model, df).select("label", "raw_prediction").collect()
    assert sum((r["raw_prediction"] >= 0.5) == bool(r["label"]) for r in got) > 0.95 * len(got)
    assert all(0 <= r["raw_prediction"] <= 1 for r in got)
    day = training.score_day(model, df, "2020-01-02")
    assert day.select("trade_date").distinct().count() == 1 and day.count() == 300
    assert day.agg(F.max("rank_value"), F.min("score"), F.max("score")).first()[0] == 300


def test_fit_fills_gaps_by_the_median_without_gathering_columns(spark, monkeypatch):
    """The Imputer sees one row; its medians are those of the training rows."""
    seen, own = [], training.Imputer.fit
    monkeypatch.setattr(training.Imputer, "fit", lambda self, df, *a: seen.append(df.count()) or own(self, df, *a))
    rows = [(float(i), None if i % 4 == 0 else float(i * i), float(i), "train" if i < 31 else "test") for i in range(40)]
    df = spark.createDataFrame(rows, "a double, b double, label double, split string")
    surrogate = training.fit(df, ["a", "b"]).stages[0].surrogateDF.first()
    assert seen == [1]
    kept = sorted(b for _, b, _, s in rows if s == "train" and b is not None)
    assert surrogate["a"] == 15.0 and surrogate["b"] == (kept[len(kept) // 2] + kept[(len(kept) - 1) // 2]) / 2
