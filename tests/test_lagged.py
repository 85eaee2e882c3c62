"""Frames by lags give what frames as arrays and Spark's aggregates give, wherever batches end."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from alphaloom.functions import catalog
from alphaloom.functions import rolling as r
from alphaloom.functions.lagged import with_lagged
from alphaloom.plans import factor_job as job

DAY = dt.date(2024, 1, 1)


def panel(spark):
    """Entities of 1 to 90 rows, some without values, one with equal ones."""
    rows = [(f"e{e}", DAY + dt.timedelta(i), None if (e + i) % 11 == 3 else 0.1 if e == 4 else float((e * 31 + i * i * 7) % 53 - 20)) for e, n in enumerate((1, 2, 7, 90, 60, 33)) for i in range(n)]
    return spark.createDataFrame(rows, "entity_code string, trade_date date, pct_chg double")


@pytest.mark.parametrize("batch", ["7", "10000"])
def test_lags_against_frames(spark, batch):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        x, d = F.col("pct_chg"), lambda p: p["pct_chg"]
        own = {
            "ema_": lambda p: p.ema(d(p), 9), "half_": lambda p: p.half_life(d(p), 30, 6), "mad_": lambda p: p.mad(d(p), 12), "sum_": lambda p: p.sum(d(p), 8), "mean_": lambda p: p.mean(d(p), 8),
            "ret_": lambda p: p.period_return(d(p), 4), "twice_": lambda p: p.ema(p.ema(d(p), 9), 9), "k_": lambda p: p.moment(d(p), 20, 4), "s_": lambda p: p.moment(d(p), 20, 3),
        }
        frames = {"ema": r.ema(x, 9), "half": r.half_life(x, 30, 6), "mad": r.mad(x, 12), "sum": r.sum_(x, 8), "mean": r.mean(x, 8), "ret": r.period_return(x, 4), "k": r.kurt(x, 20), "s": r.skew(x, 20)}
        both = r.stage(with_lagged(panel(spark), own, 29).withColumns(frames), twice=r.ema(F.col("ema"), 9)).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(both) == 193
    for row in both:
        for n in (*frames, "twice"):
            assert (row[n] is None) == (row[f"{n}_"] is None), (n, row)
            assert row[n] is None or row[f"{n}_"] == pytest.approx(row[n], rel=1e-9, abs=1e-9), (n, row)
    assert {row["k_"] for row in both if row["entity_code"] == "e4"} == {None}


def test_moments_and_nested_take_no_sliding_frame(spark):
    p = panel(spark).withColumns({n: F.abs("pct_chg") + 1 for n in ("open", "high", "low", "close", "volume")})
    deep = [n for n in catalog.NESTED if n != "Rank1M"]
    plan = catalog.nested(p, [*deep, *catalog.MOMENTS])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Window" not in plan


def whole_panel(spark):
    """Entities of 1 to 260 rows with gaps in every field, flat stretches, zeros and limits."""
    def value(e, i, k):
        if (e * 5 + i * 3 + k) % 37 == 4:
            return None
        if e == 2 or 20 < i < 48 and e == 3:  # all equal
            return 3.0
        return float((e * 31 + i * i * 7 + k * 13) % 53) / 4 + (0 if (i + e + k) % 23 == 0 else 1) - (12.0 if k == 8 else 0)

    rows = [(f"e{e}", DAY + dt.timedelta(i), *(value(e, i, k) for k in range(len(catalog.FIELDS)))) for e, n in enumerate((1, 2, 70, 260, 40)) for i in range(n)]
    return spark.createDataFrame(rows, "entity_code string, trade_date date, " + ", ".join(f"{f} double" for f in catalog.FIELDS))


@pytest.mark.parametrize("batch", ["9", "10000"])
def test_every_flat_factor_by_lags_and_by_frames(spark, batch):
    assert set(catalog.ROLLED) == set(catalog.FLAT)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        p = whole_panel(spark)
        keys = ("entity_code", "trade_date")
        frames = {tuple(x[k] for k in keys): x for x in r.with_row_index(p).select(*keys, *[v.alias(n) for n, v in catalog.columns(list(catalog.FLAT)).items()]).collect()}
        lags = catalog.nested(p, list(catalog.FLAT)).select(*keys, *catalog.FLAT).collect()
        counts = catalog.finite_counts(p, [*catalog.FLAT, *catalog.NESTED]).first()
        deep = catalog.nested(p).select(*catalog.NESTED).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(lags) == len(frames) == counts["__rows"] == 373
    for row in lags:
        want = frames[tuple(row[k] for k in keys)]
        for n in catalog.FLAT:
            a, b = row[n], want[n]
            assert (a is None) == (b is None) and (a is None or a == pytest.approx(b, rel=1e-9, abs=1e-9)), (n, row["entity_code"], row["trade_date"], a, b)
    finite = lambda rows, n: sum(x[n] is not None and math.isfinite(x[n]) for x in rows)
    for n in catalog.FLAT:
        assert counts[n] == finite(frames.values(), n) > 0, n
    for n in catalog.NESTED:
        assert counts[n] == finite(deep, n), n


def test_probe_takes_one_pass_and_shuffles_no_factor_that_is_only_counted(spark):
    """Before, factors were sliding frames, and all of them went through the shuffle of Rank1M's cross-section."""
    plan = job.probe_catalog(whole_panel(spark))._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert plan.count("MapInArrow") == 1 and windows and all("[trade_date#" in line and "MAC5" not in line for line in windows)
    one = job.probe_catalog(whole_panel(spark), "e3", ["MAC5", "Kurtosis20"]).collect()
    assert {x["factor_id"]: x["rows"] for x in one} == {"MAC5": 260, "Kurtosis20": 260}
