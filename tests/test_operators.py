"""Joins, evaluation, portfolios, datasets, metrics, sinks: tiny frames with answers worked out by hand."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from alphaloom.functions import scalar as sc
from alphaloom.operators import cross_section as x
from alphaloom.operators import datasets as d
from alphaloom.operators import diagnose as g
from alphaloom.operators import evaluate as e
from alphaloom.operators import joins as j
from alphaloom.operators import metrics as m
from alphaloom.operators import portfolio as pf
from alphaloom.operators import quality
from alphaloom.operators import selection as sel
from alphaloom.sources import panel as src
from alphaloom.sources import sinks

D = [dt.date(2024, 1, 1) + dt.timedelta(i) for i in range(40)]


def cal(spark, n=10):
    return spark.createDataFrame([(D[i], i) for i in range(n)], "trade_date date, idx long")


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_left_any_keeps_left_rows(spark):
    left = spark.createDataFrame([(1,), (1,), (2,)], "k int")
    right = spark.createDataFrame([(1, 5), (1, 7), (3, 1)], "k int, v int")
    assert rows(j.left_any(left, right, ["k"]), "k") == [(1, 7), (1, 7), (2, None)]


def test_asof_takes_the_latest_not_later(spark):
    left = spark.createDataFrame([("a", 1), ("a", 3), ("a", 9), ("b", 5)], "e string, t int")
    right = spark.createDataFrame([("a", 3, 1.0), ("a", 3, 2.0), ("a", 5, 3.0), ("c", 1, 9.0)], "e string, t int, v double")
    assert rows(j.asof_join(left, right, "e", "t", "v", 1.0), "e", "t") == [("a", 1, 1.0), ("a", 3, 2.0), ("a", 9, 3.0), ("b", 5, 1.0)]


def test_signal_executes_on_the_next_session(spark):
    df = spark.createDataFrame([("a", D[0]), ("a", D[9])], "entity_code string, signal_date date")
    assert rows(j.next_session(df, cal(spark)).select("trade_date")) == [(D[1],)]


def test_membership_is_closed_on_both_ends(spark):
    members = spark.createDataFrame([("a", D[2], D[4]), ("b", D[8], None)], "entity_code string, in_date date, out_date date")
    assert rows(j.membership(cal(spark), members), "entity_code", "trade_date") == [("a", D[2]), ("a", D[3]), ("a", D[4]), ("b", D[8]), ("b", D[9])]


def test_exactly_one_cutoff(spark):
    with pytest.raises(ValueError, match="exactly one"):
        j.as_of_event(cal(spark))


def test_text_flags_and_numbers(spark):
    bars = spark.createDataFrame([("a", D[0], 1.0), ("b", D[0], 2.0)], "entity_code string, trade_date date, close double")
    status = spark.createDataFrame([("a", D[0], "True")], "entity_code string, trade_date date, is_st string")
    extras = spark.createDataFrame([("a", D[0], "x"), ("b", D[0], "1.5")], "entity_code string, trade_date date, turn string")
    assert rows(src.panel(bars, status, extras).drop("is_kcb", "is_cyb", "is_bjs"), "entity_code") == [("a", D[0], 1.0, 1, None), ("b", D[0], 2.0, 0, 1.5)]


def prices(spark, **series):
    return spark.createDataFrame([(k, D[i], p) for k, v in series.items() for i, p in enumerate(v) if p is not None], "entity_code string, trade_date date, price double")


def test_labels_step_on_the_calendar(spark):
    """A gap on the target date gives no label, not the next row's."""
    p = prices(spark, up=[1.0] * 5 + [2.0, 2.0], down=[1.0] * 5 + [0.5, 0.5], gap=[1.0] * 5 + [None, 9.0])
    got = {(r["entity_code"], r["trade_date"]): r["label"] for r in d.rank_label(p, cal(spark), 5).collect()}
    assert got[("up", D[0])] == 1.0 and got[("down", D[0])] == 0.0 and ("gap", D[0]) not in got
    up = d.direction_label(prices(spark, UP=[1.0, 2.0], DOWN=[2.0, 1.0], FLAT=[1.0, 1.0]), cal(spark), 1)
    assert {r["entity_code"]: r["label"] for r in up.collect()} == {"UP": 1, "DOWN": 0, "FLAT": 0}


def test_weighted_mean_ignores_only_that_columns_nulls(spark):
    df = spark.createDataFrame([("i", 1.0, 1.0, 8.0), ("i", 3.0, 3.0, None), ("j", 0.0, 1.0, 1.0)], "g string, w double, a double, b double")
    assert rows(d.weighted_mean(df, ["g"], ["a", "b"], "w"), "g") == [("i", 2.5, 8.0), ("j", None, None)]


def test_split_has_gaps(spark):
    got = [r["split"] for r in d.split_dates(spark.createDataFrame([(x,) for x in D], "trade_date date"), gap=2, least=40).orderBy("trade_date").collect()]
    assert got == ["train"] * 22 + ["valid"] * 6 + ["test"] * 8
    with pytest.raises(ValueError, match="are needed"):
        d.split_dates(cal(spark))


def test_walk_forward_windows_do_not_overlap(spark):
    w = d.walk_forward(D, spark, train=10, test=5, most=3, gap=1)
    test = rows(w.where("split = 'test'").select("start_date", "end_date"), "start_date")
    assert test == [(D[25], D[29]), (D[30], D[34]), (D[35], D[39])]
    with pytest.raises(ValueError, match="overlap"):
        d.walk_forward(D, spark, train=10, test=5, step=2)


def test_portfolio_drifts_until_the_next_rebalance(spark):
    targets = spark.createDataFrame([("a", D[0], 0.5), ("b", D[0], 0.5), ("a", D[2], 1.0)], "entity_code string, trade_date date, weight double")
    ret = spark.createDataFrame([("a", 0, 1.0), ("b", 0, 0.0), ("a", 1, 0.5), ("a", 2, 0.1)], "entity_code string, idx long, ret double")
    got = rows(pf.portfolio_returns(targets, ret, cal(spark, 4)).select("trade_date", "ret"), "trade_date")
    assert [g[1] for g in got] == pytest.approx([0.5, (1.5 + 0.5) / 1.5 - 1, 0.1])
    cost = rows(pf.turnover_cost(targets, ret, cal(spark, 4)), "trade_date")
    assert cost[0][1:] == pytest.approx((0.5, 0.0003)) and cost[1][1:] == pytest.approx((0.25, 0.25 * 0.0016))


def test_performance(spark):
    daily = spark.createDataFrame([(D[0], 0.1), (D[1], -0.5), (D[2], 0.2)], "trade_date date, ret double")
    r = pf.performance(daily).first()
    assert r["total"] == pytest.approx(1.1 * 0.5 * 1.2 - 1) and r["max_drawdown"] == pytest.approx(-0.5) and r["days"] == 3


def test_quintiles_need_names(spark):
    df = spark.createDataFrame([(D[0], f"c{i:02d}", float(i)) for i in range(25)] + [(D[1], f"c{i:02d}", float(i)) for i in range(24)], "trade_date date, entity_code string, score double")
    got = pf.quintile_targets(df)
    assert got.select("trade_date").distinct().count() == 1
    assert rows(got.groupBy("bucket").agg(F.count("*"), F.sum("weight")), "bucket") == [(i, 5, pytest.approx(1.0)) for i in range(1, 6)]


def test_ic_is_one_for_perfect_order_and_null_for_a_constant(spark):
    df = spark.createDataFrame([("x", 1.0, 5.0), ("x", 2.0, 6.0), ("x", 3.0, 7.0), ("y", 1.0, 1.0), ("y", 2.0, 1.0)], "k string, a double, b double")
    assert rows(e.rank_corr(df, ["k"], "a", "b"), "k") == [("x", 3, pytest.approx(1.0)), ("y", 2, None)]


def lines(df):
    """The operators of the plan that will run first, one per line."""
    return df._jdf.queryExecution().executedPlan().toString().splitlines()


def test_mean_ranks_come_from_one_sort_per_value_in_many_parts(spark):
    """-0.0 ties with 0.0, NaN is last and ties with itself."""
    nan = float("nan")
    df = spark.createDataFrame([("x", v, 1.0) for v in (0.0, -0.0, 5.0, nan, nan, nan, -1.0)], "k string, a double, b double")
    assert [r["r"] for r in df.select("a", x.mean_rank("a", ["k"]).alias("r")).orderBy("a", "r").collect()] == [1, 2.5, 2.5, 4, 6, 6, 6]
    plan = lines(e.rank_corr(df, ["k"], "a", "b"))
    assert sum("Sort [" in line for line in plan) == 2
    assert [f", {x.DEALT})" in line for line in plan if "Exchange" in line] == [True]


def test_metrics_take_one_pass_and_count_rows_without_labels(spark):
    day = [("a", D[0], 1.0, 2.0), ("a", D[0], 2.0, 3.0), ("a", D[0], 3.0, 5.0), ("a", D[0], 9.0, None), ("a", D[1], 1.0, 2.0), ("a", D[1], 2.0, 1.0), ("a", D[2], 1.0, 1.0), ("a", None, None, 4.0)]
    odd = [("b", D[0], None, 1.0), (None, D[0], 1.0, 1.0), (None, D[0], 2.0, 2.0)]
    df = spark.createDataFrame(day + odd, "model_id string, trade_date date, prediction double, label double")
    got = m.metrics(df, ["model_id"])
    assert sum("Scan" in line for line in lines(got)) == 1
    want = ("a", 8, pytest.approx(math.sqrt(8 / 6)), 2, pytest.approx(0.0, abs=1e-12), pytest.approx(math.sqrt(2)), pytest.approx(0.0, abs=1e-12))
    assert rows(got) == [want] and got.columns == ["model_id", "rows", "rmse", "days", "ic", "ic_std", "icir"]
    assert rows(m.metrics(df.where("model_id = 'a'"), [])) == [want[1:]]
    assert rows(m.metrics(df.limit(0), ["model_id"])) == [] and rows(m.metrics(df.limit(0), [])) == [(0, None, 0, None, None, None)]


def test_stored_scores_are_evaluated_in_many_parts(spark):
    """The latest score counts, null as it may be; whatever the caller's partitions are, no sort sees a share of them."""
    at = lambda h: dt.datetime(2024, 1, 1, h)
    stored = [("a", D[0], "p", 9.0, at(1), at(1), "r1"), ("a", D[0], "p", 1.0, at(1), at(2), "r0"), ("a", D[0], "q", 2.0, at(3), at(1), "r0"), ("a", D[0], "q", 8.0, at(1), at(9), "r9"), ("a", D[0], "s", 5.0, at(1), at(1), "r0"), ("a", D[0], "s", None, at(1), at(1), "r1"), ("a", D[0], "t", 1.0, at(1), at(1), "r1")]
    df = spark.createDataFrame(stored, "model_id string, trade_date date, entity_code string, score double, updated_at timestamp, computed_at timestamp, run_id string")
    labels = spark.createDataFrame([(D[0], "p", 1.0), (D[0], "q", 2.0), (D[0], "s", 3.0), (D[0], "t", None)], "trade_date date, entity_code string, label double")
    got = m.evaluate_stored(df, labels, ["model_id"])
    assert rows(got.select("model_id", "rows", "rmse", "days", "ic")) == [("a", 2, 0.0, 1, pytest.approx(1.0))]
    # The last step, a row per date, is the caller's; labels are dealt as the scores that they meet, or broadcast.
    plan = lines(got)
    assert [line for line in plan if "hashpartitioning(" in line and f", {x.DEALT})" not in line and "hashpartitioning(model_id" not in line] == []
    assert sum("trade_date#" in line and f", {x.DEALT})" in line for line in plan) >= 2


def test_dealt_bars_are_the_same_bars(spark):
    trades = spark.createDataFrame([(c, dt.datetime(2024, 1, 1 + i % 9, i % 5), i, float(i * 7 % 11), 1.0, float(i)) for i in range(60) for c in ("a", "b", None)] + [("a", None, 1, 2.0, 1.0, 1.0)], "entity_code string, trade_time timestamp, k int, price double, volume double, amount double")
    plain, many = src.bars(trades, tie=("k",)), src.bars(trades, tie=("k",), deal=True)
    assert rows(many, "entity_code", "trade_date") == rows(plain, "entity_code", "trade_date") and plain.count() == 7
    plan = lines(many)
    assert sum("Sort [" in line for line in plan) == 1 and [f", {x.DEALT})" in line for line in plan if "Exchange" in line] == [True]


def test_m_evaluate_works_scores_out_once(spark):
    from alphaloom.queries import models

    plan = lines(models.R.queries["m_evaluate"](spark, "/root/testdata/sf0.001"))
    assert sum("Window [percent_rank(pct_chg" in line for line in plan) == 1
    assert not any("lineitem" in line or "l_shipdate" in line for line in plan)  # bars are stored once


def test_psi_and_ks(spark):
    same = [(s, float(i)) for s in ("train", "test") for i in range(100)]
    df = spark.createDataFrame(same, "split string, v double")
    assert m.psi(df, "v", "split", "train").first()["psi"] == pytest.approx(0, abs=1e-9)
    assert m.ks(df, "v", "split", "train", "test").first()["ks"] == 0
    moved = spark.createDataFrame([("train", float(i)) for i in range(100)] + [("test", 1000.0 + i) for i in range(100)], "split string, v double")
    assert m.psi(moved, "v", "split", "train").first()["psi"] > 1 and m.ks(moved, "v", "split", "train", "test").first()["ks"] == 1


def test_auc_counts_ties_half(spark):
    df = spark.createDataFrame([("m", 0.9, 1), ("m", 0.5, 1), ("m", 0.5, 0), ("m", 0.1, 0)], "k string, probability double, label int")
    assert m.class_metrics(df, ["k"]).first()["auc"] == pytest.approx(3.5 / 4)


def test_ensemble_needs_all_sources(spark):
    p = spark.createDataFrame([(D[0], "a", "x", 1.0), (D[0], "a", "y", 0.0), (D[0], "b", "x", 0.2), (D[0], "c", "x", 0.0), (D[0], "c", "y", 0.0)], "trade_date date, entity_code string, model_id string, score double")
    w = spark.createDataFrame([("x", 0.75), ("y", 0.25)], "model_id string, weight double")
    assert rows(m.ensemble(p, w).select("entity_code", "score", "rank_value", "percentile"), "entity_code") == [("a", 0.75, 1, 0.0), ("c", 0.0, 2, 1.0)]


def test_ensemble_adds_in_the_order_of_models(spark):
    """Whatever order the rows arrive in, a sum has one value; order is that of floor(sum * 1e12 + 0.5)."""
    exact = lambda a, b, c: (0.5 * a + 0.3 * b + 0.2 * c) / (0.5 + 0.3 + 0.2)
    scores = [(2 * (i * 37 % 101) / 7919 - 1, 2 * (i * 53 % 103) / 7919 - 1, 2 * (i * 71 % 107) / 7919 - 1) for i in range(300)]
    want = {f"e{i:03}": math.floor(exact(*s) * 1e12 + 0.5) / 1e12 for i, s in enumerate(scores)}
    place = {k: n for n, (k, _) in enumerate(sorted(want.items(), key=lambda x: (-x[1], x[0])), 1)}
    w = spark.createDataFrame([("a", 0.5), ("b", 0.3), ("c", 0.2)], "model_id string, weight double")
    for order in ("abc", "cab", "bca"):
        p = spark.createDataFrame([(D[0], f"e{i:03}", n, s["abc".index(n)]) for n in order for i, s in enumerate(scores)], "trade_date date, entity_code string, model_id string, score double")
        got = m.ensemble(p.coalesce(1), w).collect()
        assert {r["entity_code"]: r["score"] for r in got} == want
        assert {r["entity_code"]: r["rank_value"] for r in got} == place
    large = m.ensemble(spark.createDataFrame([(D[0], e, n, v) for e, v in (("x", 1e7), ("y", 2e7)) for n in "abc"], "trade_date date, entity_code string, model_id string, score double"), w)
    assert [r["score"] for r in large.orderBy("rank_value").collect()] == [2e7, 1e7]


def test_membership_of_overlapping_spans_needs_no_distinct(spark):
    m_ = spark.createDataFrame([("a", D[0], D[3]), ("a", D[1], D[2]), ("a", D[2], D[5]), ("a", D[8], None), ("b", D[4], D[4]), ("b", D[4], D[4])], "entity_code string, in_date date, out_date date")
    got = j.membership(cal(spark), m_)
    assert rows(got, "entity_code", "trade_date") == [*[("a", D[i]) for i in (0, 1, 2, 3, 4, 5, 8, 9)], ("b", D[4])]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [entity_code" not in plan


def test_compose_leaves_out_in_batches_what_cannot_be_on_top(spark):
    scores = [(D[i % 2], f"n{i:03}", n, float("nan") if i == 7 else float((i * 37 + k) % 61)) for i in range(200) for k, n in enumerate("ab")]
    p = spark.createDataFrame(scores, "trade_date date, entity_code string, engine string, score double")
    w = spark.createDataFrame([("a", 1, 0.5, 10.0, 3), ("b", 2, 0.5, 20.0, 5)], "engine string, priority int, weight double, threshold double, top_n int")
    place = lambda s: (0, 0) if s != s else (1, -s)
    want = set()
    for n, least, top in (("a", 10, 3), ("b", 20, 5)):
        for day in D[:2]:
            own = sorted((place(s), c) for d_, c, e_, s in scores if (d_, e_) == (day, n) and not s < least)
            want |= {(day, n, c, i) for i, (_, c) in enumerate(own[:top], 1)}
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        got = pf.compose(p, w)
        assert {(r["trade_date"], r["engine"], r["entity_code"], r["position"]) for r in got.collect()} == want
        assert "MapInArrow" in got._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_predictions_deal_dates_into_many_parts(spark):
    """Whatever the caller's number of partitions is, a task sorts few dates at a time."""
    from alphaloom.queries import evaluation

    plan = evaluation.predictions(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    dates = [line for line in plan.splitlines() if "hashpartitioning(trade_date" in line]
    assert len(dates) == 1 and f", {evaluation.DEALT})" in dates[0]


def test_trend(spark):
    df = spark.createDataFrame([("a", D[i], s) for i, s in enumerate([1.0, 2.0, 3.0, 2.0, 2.0])] + [("b", D[0], 1.0)], "entity_code string, trade_date date, score double")
    got = [(r["trend"], r["buyable"]) for r in sel.trend(df).orderBy("entity_code", "trade_date").collect()]
    assert got == [("连续上升", 0), ("连续上升", 0), ("先升后降", 1), ("连续下降", 0), ("回落中", 1), ("趋势未知", 1)]
    past = [r["trend"] for r in sel.trend(df, ahead=False).orderBy("entity_code", "trade_date").collect()]
    assert past == ["趋势未知", "上升中", "上升中", "回落中", "回落中", "趋势未知"]


def test_bands_at_their_edges(spark):
    x = spark.createDataFrame([(-0.25,), (-0.1,), (-0.06,), (0.0,), (0.06,), (0.1,), (0.12,), (0.2,), (None,)], "x double").select("x", sc.score_band(F.col("x")).alias("s"), sc.market_state(F.col("x")).alias("m"), sc.market_regime(F.col("x")).alias("r"), sc.position_advice(F.col("x"), F.lit(3)).alias("p"))
    assert [tuple(r)[1:] for r in x.collect()] == [
        ("≤-0.25", "熊市", "bear", "0%"), ("-0.15~-0.10", "熊市", "bear", "0%"), ("-0.10~-0.06", "熊市", "sideways", "0%"), (None, "熊市", "sideways", "0%"),
        (None, "震荡偏弱", "bull", "0-30%"), (None, "震荡偏强", "bull", "50%"), (None, "牛市", "bull", "50%"), (None, "牛市", "strong_bull", "50%"), (None, None, "unknown", None),
    ]


def test_negative_rules(spark):
    df = spark.createDataFrame([("600001.SH", -0.23, 2e11), ("600002.SH", -0.135, 2e11), ("600003.SH", -0.11, 5e10), ("688001.SH", -0.14, 1e9), ("000001.SZ", -0.05, 1e9), ("830001.BJ", -0.3, None)], "entity_code string, score double, cap double").withColumn("trade_date", F.lit(D[0]))
    low = sel.negative_selection(df)
    assert rows(low.select("entity_code", "cap_band", "board", "short", "missed"), "entity_code") == [
        ("600001.SH", "超大盘", "沪深主板", 1, 0), ("600002.SH", "超大盘", "沪深主板", 0, 1), ("600003.SH", "大盘", "沪深主板", 0, 1), ("688001.SH", "微盘", "科创板", 1, 1), ("830001.BJ", "未知", "北交所", 1, 0),
    ]
    grid = sel.negative_matrix(low).collect()
    assert len(grid) == 5 and sum(sum(r[n] for n in ("微盘", "小盘", "中盘", "大盘", "超大盘")) for r in grid) == 4


def test_gates(spark):
    good = {"validation_days": 40, "validation_rank_ic": 0.02, "validation_ic_ir": 0.3, "test_days": 40, "test_rank_ic": 0.02, "test_ic_ir": 0.3, "trading_days": 40, "excess_annual_return": 0.01, "sharpe_ratio": 0.1, "max_drawdown": -0.3}
    cases = {"all": good, "zero excess": good | {"excess_annual_return": 0.0}, "missing": {k: v for k, v in good.items() if k != "test_days"}}
    long = spark.createDataFrame([(i, k, float(v)) for i, c in cases.items() for k, v in c.items()], "id string, metric string, value double")
    got = {r["id"]: (r["passed"], r["failed"]) for r in m.gate(long).collect()}
    assert got == {"all": (1, []), "zero excess": (0, ["excess_annual_return"]), "missing": (0, ["test_days"])}
    w = spark.createDataFrame([("a", i, 0.03) for i in range(3)] + [("b", 1, 0.5), ("b", 2, -0.2)], "id string, window int, rank_ic double")
    st = m.stability_gate(w, spark.createDataFrame([("a", 0.4), ("b", 0.1)], "id string, ic_ir double"))
    assert {r["id"]: r["status"] for r in st.collect()} == {"a": "stable", "b": "insufficient_windows"}


def test_training_curves(spark):
    curves = {"steady": [(1.0, 1.0), (0.5, 0.55), (0.45, 0.5)], "far": [(1.0, 1.0), (0.2, 0.5), (0.1, 0.5)], "rebound": [(1.0, 1.0), (0.48, 0.5), (0.4, 0.53)], "flat": [(1.0, 1.0), (1.0, 1.0), (1.0, 1.0)]}
    h = spark.createDataFrame([(n, i, t, v) for n, c in curves.items() for i, (t, v) in enumerate(c)], "run string, step int, train double, valid double")
    got = {r["run"]: (r["best_step"], r["status"]) for r in g.training_curve(h).collect()}
    assert got == {"steady": (2, "stable"), "far": (1, "severe"), "rebound": (1, "warning"), "flat": (0, "warning")}
    long = spark.createDataFrame([("r", i, 1.0, abs(i - 777) / 1000) for i in range(1000)], "run string, step int, train double, valid double")
    steps = {r["step"] for r in g.curve_points(long, 100).collect()}
    assert {0, 777, 999} <= steps and len(steps) <= 101


def test_redundant_features_form_groups(spark):
    pairs = spark.createDataFrame([("a", "b", 1), ("b", "c", 1), ("d", "e", 1), ("a", "f", 0)], "feature_a string, feature_b string, redundant int")
    strength = spark.createDataFrame([(f, 0.01, ir) for f, ir in (("a", 0.1), ("b", -0.9), ("c", 0.2), ("d", 0.3), ("e", 0.3), ("f", 2.0))], "feature string, rank_ic double, ic_ir double")
    assert rows(g.redundancy_groups(pairs, strength), "feature") == [("a", "a", 0), ("a", "b", 1), ("a", "c", 0), ("d", "d", 0), ("d", "e", 1)]
    assert g.redundancy_groups(pairs.where("redundant = 0"), strength).count() == 0


@pytest.mark.parametrize("unit", ["month", "year", None])
def test_asof_of_a_busy_entity(spark, unit):
    """One entity holds half of all rows; values are carried over months without rows, nulls match nothing."""
    import random

    rng = random.Random(3)
    day = lambda: dt.date(2020, 1, 1) + dt.timedelta(rng.randrange(900))
    names = ["busy"] * 6 + ["a", "b", "c", "d", "e", None]
    left = [(i, rng.choice(names), day() if rng.random() < 0.97 else None) for i in range(600)]
    right = [(rng.choice(names), day() if rng.random() < 0.97 else None, rng.choice([None, 1.0, 2.0, 5.0, float(i)])) for i in range(80)]
    got = j.asof_join(spark.createDataFrame(left, "i int, e string, d date"), spark.createDataFrame(right, "e string, d date, v double"), "e", "d", "v", unit=unit).collect()
    best = {}
    for e, d, v in right:
        if e is not None and d is not None and v is not None:
            best[e, d] = max(v, best.get((e, d), v))
    for r in got:
        seen = [(d, v) for (e, d), v in best.items() if e == r["e"] and r["d"] is not None and d <= r["d"]]
        assert r["v"] == (max(seen)[1] if seen else None)
    assert len(got) == 600


def test_components_of_a_long_path(spark):
    """2,000 features in a row, in an order without meaning, and a ring apart from them."""
    order = [f"f{(i * 7919) % 2000:04d}" for i in range(2000)]
    edges = [*zip(order, order[1:], strict=False), ("x1", "x2"), ("x2", "x3"), ("x3", "x1"), ("y", "y"), (None, "z")]
    got = {r["node"]: r["leader"] for r in g.components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == {f: "f0000" for f in order} | {"x1": "x1", "x2": "x1", "x3": "x1", "y": "y"}


def test_psi_of_a_constant(spark):
    same = spark.createDataFrame([("train", 2.0)] * 10 + [("test", 2.0)] * 5, "split string, v double")
    assert m.psi(same, "v", "split", "train").first()["psi"] == pytest.approx(0, abs=1e-9)
    apart = spark.createDataFrame([("train", 2.0)] * 10 + [("test", 3.0)] * 5, "split string, v double")
    assert m.psi(apart, "v", "split", "train").first()["psi"] > 10


def predictions(spark, scores):
    return spark.createDataFrame([(f"e{i}", D[0], "m", 1, s, s) for i, s in enumerate(scores)], "entity_code string, trade_date date, model_id string, model_version int, raw_prediction double, score double")


def test_sinks(spark, tmp_path):
    path = str(tmp_path)
    assert sinks.write_predictions(predictions(spark, [0.1, 0.2]), path) == 2
    assert sinks.write_predictions(predictions(spark, [0.3]), path) == 1
    with pytest.raises(ValueError, match="within"):
        sinks.write_predictions(predictions(spark, [2.0]), path)
    with pytest.raises(ValueError, match="no predictions"):
        sinks.write_predictions(predictions(spark, [0.1]).limit(0), path)
    with pytest.raises(ValueError, match="repeated"):
        sinks.write_predictions(predictions(spark, [0.1]).unionByName(predictions(spark, [0.2])), path)
    df = cal(spark)
    assert sinks.snapshot(df, "one", path).count() == 10
    assert sinks.snapshot(df.limit(3), "one", path).count() == 10
    assert sinks.fingerprint(df) == sinks.fingerprint(df.orderBy(F.col("idx").desc()))


def _job(days, job, make=1.0):
    return [("e", dt.date(2020, *d), make, job) for d in days]


def test_superseding_leaves_no_stale_rows(spark, tmp_path):
    """A month in which the new job has no rows loses its old ones; other months and scopes stay."""
    path = f"{tmp_path}/values"
    schema = "entity_code string, trade_date date, raw_value double, job string"
    for job, days in (("old", [(1, 5), (2, 5), (3, 5), (5, 5)]), ("new", [(1, 5), (3, 5)])):
        df = spark.createDataFrame(_job(days, job), schema).drop("job")
        sinks.write_values(sinks.value_rows(df, "f", 1, "", job, "v"), path)
    sinks.write_values(sinks.value_rows(spark.createDataFrame(_job([(2, 5)], "x"), schema).drop("job"), "g", 1, "", "old", "v"), path)
    for _ in range(2):  # done again, it changes nothing
        sinks.supersede(spark, path, "new")
        kept = sorted((r["factor_id"], r["job_id"], r["trade_date"].month) for r in spark.read.parquet(path).collect())
        assert kept == [("f", "new", 1), ("f", "new", 3), ("f", "old", 5), ("g", "old", 2)]
    sinks.supersede(spark, path, "new", "2020-01-01", "2020-12-31")
    assert sorted((r["factor_id"], r["trade_date"].month) for r in spark.read.parquet(path).collect()) == [("f", 1), ("f", 3), ("g", 2)]
    assert [p.name for p in tmp_path.iterdir()] == ["values"]


def test_snapshot_after_a_crash(spark, tmp_path):
    path = str(tmp_path)
    cal(spark).limit(2).write.parquet(f"{path}/one/rows")  # rows without a fingerprint: a job that broke off
    assert sinks.snapshot(cal(spark), "one", path).count() == 10
    assert sinks.snapshot(cal(spark).limit(1), "one", path).count() == 10


def test_refresh_from_a_stream(spark, tmp_path):
    """Batches of new panel rows through foreachBatch: the dates of each are computed anew and replace older values."""
    from alphaloom.streaming.refresh import refresh_batch

    source, path = f"{tmp_path}/panel", f"{tmp_path}/values"
    panel = lambda s: s.read.schema("entity_code string, trade_date date, close double").parquet(source)
    step = refresh_batch(panel, lambda p: p.withColumn("raw_value", F.col("close")), 1, path, "f")
    put = lambda days, close: spark.createDataFrame([(e, dt.date(2020, 1, d), close + i) for d in days for i, e in enumerate("abc")], "entity_code string, trade_date date, close double").coalesce(1).write.mode("append").parquet(source)
    for days, close in (([1, 2], 1.0), ([3], 5.0)):
        put(days, close)
        stream = spark.readStream.schema("entity_code string, trade_date date, close double").parquet(source)
        query = stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{tmp_path}/offsets").trigger(availableNow=True).start()
        assert query.awaitTermination(120)
    rows = spark.read.parquet(path).collect()
    got = sorted((r["entity_code"], r["trade_date"].day, r["raw_value"]) for r in rows)
    assert got == sorted([(e, d, 1.0 + i) for d in (1, 2) for i, e in enumerate("abc")] + [(e, 3, 5.0 + i) for i, e in enumerate("abc")])
    jobs = {r["job_id"] for r in rows}
    assert len(jobs) == 2 and len({j.rsplit("-", 1)[0] for j in jobs}) == 1  # two batches of one stream
    # A checkpoint that is lost: its stream starts again with number 0, under another id, and what it computes counts.
    query = spark.readStream.schema("entity_code string, trade_date date, close double").parquet(source).writeStream.foreachBatch(step)
    query = query.option("checkpointLocation", f"{tmp_path}/offsets2").trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    again = spark.read.parquet(path).collect()
    assert sorted((r["entity_code"], r["trade_date"].day, r["raw_value"]) for r in again) == got
    assert not {r["job_id"] for r in again} & jobs


def test_replayed_batches_change_nothing(spark, tmp_path):
    """A batch that comes again, with or without its entry in the ledger."""
    from alphaloom.sources import manifest
    from alphaloom.streaming.refresh import ledger, refresh_batch

    path = f"{tmp_path}/values"
    panel = spark.createDataFrame([(e, dt.date(2020, 1, d), 1.0 * d) for d in (1, 2, 3) for e in "ab"], "entity_code string, trade_date date, close double")
    step = refresh_batch(lambda s: panel, lambda p: p.withColumn("raw_value", F.col("close")), 1, path, "f", "stream")
    step(panel, 0)
    first = sorted(map(str, spark.read.parquet(path).collect()))
    step(panel, 0)
    assert sorted(map(str, spark.read.parquet(path).collect())) == first and ledger(spark, path).count() == 1
    manifest.remove(spark, f"{path}/_ledger")  # broken off before the ledger was written
    step(panel, 0)
    assert sorted(map(str, spark.read.parquet(path).collect())) == first and ledger(spark, path).count() == 1
    step(panel.limit(0), 1)
    assert ledger(spark, path).count() == 2


def test_a_refresh_reads_the_files_of_its_month_only(spark, tmp_path):
    from alphaloom.sources import manifest

    path = f"{tmp_path}/values"
    make = lambda days: spark.createDataFrame([(e, d, 1.0) for d in days for e in "abc"], "entity_code string, trade_date date, raw_value double")
    days = [dt.date(2020, 1, 1) + dt.timedelta(i) for i in range(400)]
    sinks.write_values(sinks.value_rows(make(days).repartition(3), "f", 1, "", "all", "v"), path)
    files = manifest.manifest(spark, path).select("file").distinct().count()
    sinks.write_values(sinks.value_rows(make(days[200:201]), "f", 1, "", "day", "v"), path)
    done = sinks.supersede(spark, path, "day")
    assert done == {"rewritten": 3, "dropped": 0} and files > 30
    got = manifest.read_values(spark, path)
    assert got.count() == spark.read.parquet(path).count() == 1200
    assert {r["job_id"] for r in got.where(F.col("trade_date") == days[200]).collect()} == {"day"}
    sinks.write_values(sinks.value_rows(make(days[213:244]), "f", 1, "", "month", "v"), path)  # August
    assert sinks.supersede(spark, path, "month") == {"rewritten": 0, "dropped": 3}
    last = manifest.latest_dates(spark, path).collect()
    assert [(r["rows"], r["first_date"], r["last_date"]) for r in last] == [(1200, days[0], days[-1])]
    # Files that no version lists are not read, and are not taken over by another job.
    sinks.value_rows(make(days[:1]), "f", 1, "", "broken", "v").write.mode("append").partitionBy("month", "factor_id").parquet(path)
    assert manifest.read_values(spark, path).count() == 1200
    sinks.write_values(sinks.value_rows(make(days[1:2]), "f", 1, "", "after", "v"), path)
    assert manifest.read_values(spark, path).where("job_id = 'broken'").count() == 0


def test_snapshot_pair_names_what_was_changed(spark, tmp_path):
    path = str(tmp_path)
    raw = spark.createDataFrame([("train", 1, None), ("train", 2, 2.0), ("test", 3, None)], "split string, i int, v double")
    pair = {"raw": raw, "imputed": raw.fillna(9.0)}
    out = sinks.snapshot_of(pair, "d", path, F.col("split"))
    assert out["raw"].count() == out["imputed"].count() == 3
    kept = sinks.snapshot_root(spark, "d", path)
    again = sinks.snapshot_of({"raw": raw.limit(1), "imputed": raw.limit(1)}, "d", path, F.col("split"))  # written once
    assert again["imputed"].count() == 3 and sinks.snapshot_root(spark, "d", path) == kept
    spark.createDataFrame([("test", 3, 8.0), ("train", 1, 9.0), ("train", 2, 2.0)], raw.schema).write.mode("overwrite").parquet(f"{path}/d/imputed")
    with pytest.raises(RuntimeError, match=r"changed: imputed/test$"):
        sinks.snapshot_of(pair, "d", path, F.col("split"))


def test_sessions_from(spark):
    c = cal(spark)
    days = [r["trade_date"] for r in c.orderBy("idx").collect()]
    asked = spark.createDataFrame([(days[0],), (days[3],), (days[-1],), (days[-1] + dt.timedelta(9),), (None,)], "d date")
    at = lambda strict: {r["d"]: r["idx"] for r in j.sessions_from(asked, "d", c, strict).collect()}
    assert at(False) == {days[0]: 0, days[3]: 3, days[-1]: 9, days[-1] + dt.timedelta(9): None}
    assert at(True) == {days[0]: 1, days[3]: 4, days[-1]: None, days[-1] + dt.timedelta(9): None}


def test_entry_and_registry(spark):
    import __spark_entry__

    q, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(q) and len(q) > 100
    assert __spark_entry__.entry(spark).columns == ["entity_code", "trade_date", "raw_value", "processed", "percentile", "score", "rank_value"]


def test_walk_forward_query_fits_every_window(spark):
    from alphaloom.queries import jobs

    rows = jobs.R.queries["m_walk_forward"](spark, "/root/testdata/sf0.001").select("fold", "trade_date").distinct().collect()
    assert sorted({r["fold"] for r in rows}) == [1, 2, 3, 4]
    assert len({r["trade_date"] for r in rows}) == len(rows) <= 4 * 21


def test_upsert_definition(spark):
    shape = "factor_id string, version int, expression string"
    old = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], shape)
    new = spark.createDataFrame([("a", 2, "w"), ("b", 1, "z"), ("b", 2, "v"), ("c", 5, "u")], shape)
    got = sorted(tuple(r) for r in quality.upsert_definition(old, new).collect())
    assert got == [("a", 1, "x"), ("a", 2, "w"), ("b", 1, "z"), ("b", 2, "v"), ("c", 5, "u")]
    with pytest.raises(ValueError, match="conflicting"):
        quality.upsert_definition(old, spark.createDataFrame([("a", 1, "changed")], shape))
