"""Order statistics over whole columns: quantiles, gaps and wins against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from alphaloom.operators import metrics, ordered


def columns(rng, n):
    return {
        "even": rng.normal(size=n), "ties": rng.integers(0, 5, n).astype(float), "one": np.full(n, 7.0), "tail": rng.standard_cauchy(n) ** 3,
        "shifted": 1e9 + rng.random(n), "tiny": rng.random(n) * 1e-200, "mixed": np.where(rng.random(n) < 0.5, 1e30, rng.random(n)),
    }


@pytest.mark.parametrize("small", [10**6, 40, 1])
def test_exact_quantiles(spark, small, monkeypatch):
    monkeypatch.setattr(ordered, "CELLS", 16)
    cols = columns(np.random.default_rng(2), 500)
    rows = [(k, float(v)) for k, values in cols.items() for v in values] + [("even", None), ("even", math.nan), ("none", None), (None, 1.0), (None, 4.0)]
    points = [0.0, 0.1, 0.25, 0.5, 0.777, 1.0]
    got = {r["k"]: r for r in ordered.exact_quantiles(spark.createDataFrame(rows, "k string, v double"), "v", points, ["k"], small).collect()}
    assert set(got) == {*cols, None}
    for k, values in [*cols.items(), (None, [1.0, 4.0])]:
        assert got[k]["n"] == len(values)
        assert np.allclose(got[k]["q"], np.quantile(values, points), rtol=1e-12, atol=0), k
    plain = ordered.exact_quantiles(spark.createDataFrame(rows, "k string, v double").where("k = 'even'"), "v", [0.5], [], small).first()
    assert plain["q"][0] == pytest.approx(np.quantile(cols["even"], 0.5), rel=1e-12)


def test_gaps_and_wins(spark, monkeypatch):
    monkeypatch.setattr(ordered, "CELLS", 8)
    rng = np.random.default_rng(4)
    cols = columns(rng, 300)
    rows = [(k, float(v), int(rng.random() < 0.4)) for k, values in cols.items() for v in values] + [("lone", 1.0, 1)]
    df = spark.createDataFrame(rows, "k string, high double, y int")
    gap = {r["k"]: r["gap"] for r in ordered.gaps(df, "high", F.col("y") == 1, F.col("y") == 0, ["k"]).collect()}
    won = {r["k"]: r for r in ordered.wins(df, "high", F.col("y") == 1, F.col("y") == 0, ["k"]).collect()}
    for k in cols:
        a, b = (np.array([v for key, v, y in rows if key == k and y == side]) for side in (1, 0))
        every = np.concatenate([a, b])
        assert gap[k] == pytest.approx(max(abs((a <= v).mean() - (b <= v).mean()) for v in every), abs=1e-12), k
        assert won[k]["wins"] == (a[:, None] > b).sum() + (a[:, None] == b).sum() / 2
        assert (won[k]["na"], won[k]["nb"]) == (len(a), len(b))
    assert gap["lone"] is None and won["lone"]["wins"] == 0


def test_no_task_sees_all_values(spark):
    """Values are exchanged by their cell; only sums of cells meet in one partition."""
    df = spark.range(1000).select((F.col("id") % 97).cast("double").alias("v"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("side"))
    plan = metrics.ks(df, "v", "side", "a", "b")._jdf.queryExecution().executedPlan().toString()
    single = [line for line in plan.splitlines() if "SinglePartition" in line]
    below = plan[plan.index("SinglePartition") :] if single else ""
    assert "hashpartitioning(__cell" in plan and (not single or "__cell" in below)


def test_gaps_put_only_cells_in_order_that_may_hold_the_largest(spark, monkeypatch):
    """Before, all rows were shuffled twice to put every cell in order."""
    rng, kept, store = np.random.default_rng(9), [], ordered.stored
    monkeypatch.setattr(ordered, "stored", lambda df: kept.append(store(df)) or kept[-1])
    rows = [(k, float(round(rng.normal() + shift * side, 3)), side) for k, shift in (("far", 1.0), ("near", 0.1), ("same", 0.0)) for side in (0, 1) for _ in range(4000)]
    rows += [("odd", v, side) for side in (0, 1) for v in (1.0, 1.0, 2.0 + side, float("nan"), None)] + [(None, v, int(v > 3)) for v in (1.0, 5.0, 2.0, 4.0)]
    df = spark.createDataFrame(rows, "k string, v double, y int")
    got = {r["k"]: r["gap"] for r in ordered.gaps(df, "v", F.col("y") == 1, F.col("y") == 0, ["k"]).collect()}
    for key in ("far", "near", "same", "odd", None):
        a, b = (np.array([v for k, v, y in rows if k == key and y == side and v is not None and v == v]) for side in (1, 0))
        assert got[key] == pytest.approx(max(abs((a <= v).mean() - (b <= v).mean()) for v in [*a, *b]), abs=1e-12), key
    cells, open_ = kept[1], kept[2]
    assert open_.where("k = 'far'").count() < cells.where("k = 'far'").count() / 5
    assert got["odd"] == pytest.approx(1 / 3) and got[None] == 1
