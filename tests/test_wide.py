"""Rows with a column per feature give what rows per feature give, from one shuffle of each row."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from alphaloom.operators import datasets as d
from alphaloom.operators import diagnose as g
from alphaloom.operators import evaluate as e
from alphaloom.queries import base, diagnosis, evaluation, models

SF = "/root/testdata/sf0.001"
DAY = dt.date(2020, 1, 1)
NAMES = ["x", "y", "z", "none"]


def wide_rows(spark, entities=40, days=12):
    """x follows the label, y is minus x with gaps, z is constant on some days, none has no values; some rows lack labels."""
    rng, rows = random.Random(7), []
    for i in range(days):
        for k in range(entities - (30 if i == 4 else 0)):
            label = rng.gauss(0, 1)
            x = round(label + rng.gauss(0, 1), 1)
            rows.append((DAY + dt.timedelta(i), f"e{k}", None if k % 9 == 5 else label, ("train", "valid", None)[min(i // 5, 2)], x, None if k % 5 == 3 else -x, 1.0 if i % 3 == 0 else rng.random(), None))
    return spark.createDataFrame(rows, "trade_date date, entity_code string, label double, split string, x double, y double, z double, none double")


def long_rows(df):
    return df.unpivot(["trade_date", "entity_code", "label", "split"], NAMES, "feature", "value").where("value is not null")


def table(df, *by):
    return [tuple(None if v is None else pytest.approx(v, rel=1e-9, abs=1e-12) if isinstance(v, float) else v for v in r) for r in df.select(*sorted(df.columns)).orderBy(*by).collect()]


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def test_wide_rows_against_long_ones(spark):
    df = wide_rows(spark)
    assert table(g.redundancy(df, 20, names=NAMES), "feature_a", "feature_b") == table(g.redundancy(long_rows(df), 20), "feature_a", "feature_b")
    known = df.where("label is not null")
    for least in (5, 30):
        got = g.factor_audit(known, least=least, names=NAMES)
        assert table(got, "feature") == table(g.factor_audit(long_rows(known), least=least), "feature") and got.count() == 3
    daily = e.rank_corrs(df, ["trade_date"], NAMES, "label")
    for n in NAMES:
        assert table(daily.where(F.col("feature") == n).drop("feature"), "trade_date") == table(e.rank_corr(df, ["trade_date"], n, "label"), "trade_date")


def test_wide_rows_are_shuffled_once(spark):
    df = wide_rows(spark)
    assert exchanges(g.redundancy(df, names=NAMES)) == 2 < exchanges(g.redundancy(long_rows(df)))  # by date, then pairs
    assert exchanges(e.rank_corrs(df, ["trade_date"], NAMES, "label")) == 1


def test_edges_are_worked_out_once(spark):
    """Before, both directions of an edge were taken from two readings of what gives them."""
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y")], "a string, b string").mapInArrow(seen, "a string, b string")
    assert {r["node"]: r["leader"] for r in g.components(edges).collect()} == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x"}
    assert read.value == 3


def test_labelled_rows_are_the_rows_with_their_labels(spark):
    rows = [(f"e{k}", DAY + dt.timedelta(7 * i), float((k * 7 + i * i) % 11 + 1), k) for k in range(9) for i in range(8) if (k + i) % 6]
    df = spark.createDataFrame(rows, "entity_code string, trade_date date, price double, k int")
    cal = spark.createDataFrame([(DAY + dt.timedelta(7 * i), i) for i in range(8)], "trade_date date, idx long")
    got = d.labelled_rows(df, cal, 3)
    assert got.count() == len(rows) and set(got.columns) == {"entity_code", "trade_date", "price", "k", "ret", "label"}
    want = d.realized_labels(df.drop("k"), cal, 3)
    assert table(got.where("ret is not null").select(*want.columns), "entity_code", "trade_date") == table(want, "entity_code", "trade_date")
    assert got.where("ret is null and label is not null").count() == 0


def test_scores_side_by_side_are_those_of_predictions(spark):
    long = evaluation.predictions(spark, SF).groupBy("entity_code", "trade_date").pivot("engine", ["a", "b", "c"]).agg(F.max("score"))
    wide = evaluation.side_scores(base.panel(spark, SF)).select("entity_code", "trade_date", "a", "b", "c")
    assert wide.count() == base.panel(spark, SF).count()
    assert table(wide.where("coalesce(a, b, c) is not null"), "entity_code", "trade_date") == table(long, "entity_code", "trade_date")


@pytest.mark.parametrize("module, name", [(models, "m_gram_lines"), (diagnosis, "g_redundancy_groups"), (diagnosis, "g_attribution")])
def test_bars_are_made_once_and_hold_what_is_needed(spark, monkeypatch, module, name):
    made, make = [], base.source.bars
    monkeypatch.setattr(base.source, "bars", lambda *a, **b: made.append(1) or make(*a, **b))
    kept, once = {}, base.once
    monkeypatch.setattr(base, "once", lambda n, f: kept.setdefault(n, once(n, f)))
    module.R.queries[name](spark, SF)
    assert len(made) == 1 and set(kept["bars"].columns) == {"entity_code", "trade_date", "close", "volume"}


def test_windows_share_the_ranks_of_their_dates(spark):
    """Windows that overlap, one without dates; ICs against each window's own rows, one by one."""
    df = wide_rows(spark).where("label is not null").select("trade_date", "entity_code", "label", "x", "y", "z")
    at = lambda i: DAY + dt.timedelta(i)
    spans = [(1, "train", 0, 5), (1, "test", 6, 8), (2, "train", 2, 8), (2, "test", 9, 11), (3, "train", 50, 60), (3, "test", 61, 62)]
    windows = spark.createDataFrame([(w, s, at(a), at(z)) for w, s, a, z in spans], "window int, split string, start_date date, end_date date")
    model = spark.createDataFrame([(1, 0.1), (2, 0.2)], "window int, model_rank_ic double")
    got = {(r["window"], r["feature"]): r for r in g.walk_forward_attribution(df, ["x", "y", "z"], windows, model).collect()}
    assert set(got) == {(w, f) for w in (1, 2) for f in "xyz"}
    for w, side, a, z in spans[:4]:
        for f in "xyz":
            own = e.rank_corr(df.where(F.col("trade_date").between(at(a), at(z))), ["trade_date"], f, "label").where("n >= 18").collect()  # half of the median of 36 names
            ics = [r["ic"] for r in own if r["ic"] is not None]
            assert got[w, f][f"{side}_rank_ic"] == pytest.approx(sum(ics) / len(ics), abs=1e-12), (w, side, f)
    sides = [{f: [r[f] for r in df.where(F.col("trade_date").between(at(a), at(z)) & F.col(f).isNotNull()).collect()] for f in "xyz"} for a, z in ((2, 8), (9, 11))]
    for f in "xyz":
        share = lambda v, x: sum(y <= x for y in v) / len(v)
        assert got[2, f]["ks"] == pytest.approx(max(abs(share(sides[0][f], x) - share(sides[1][f], x)) for x in sides[0][f] + sides[1][f]), abs=1e-12)
