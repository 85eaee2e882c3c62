"""Scalar, rolling and cross-sectional functions on tiny frames with answers worked out by hand."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from alphaloom.functions import catalog
from alphaloom.functions import rolling as r
from alphaloom.functions import scalar as s
from alphaloom.operators import cross_section as x
from alphaloom.plans import factor_job as job

DAY = dt.date(2024, 1, 1)


def series(spark, values, entity="A"):
    return spark.createDataFrame([(entity, DAY + dt.timedelta(i), v) for i, v in enumerate(values)], "entity_code string, trade_date date, v double")


def last(df, column):
    return [row[0] for row in df.withColumn("out", column).orderBy("trade_date").select("out").collect()]


V = [10.0, 12.0, 11.0, None, 15.0]


@pytest.mark.parametrize(
    ("make", "want"),
    [
        (lambda v: r.mean(v, 3), [10, 11, 11, 11.5, 13]),
        (lambda v: r.sum_(v, 2), [10, 22, 23, 11, 15]),
        (lambda v: r.max_(v, 3), [10, 12, 12, 12, 15]),
        (lambda v: r.min_(v, 3), [10, 10, 10, 11, 11]),
        (lambda v: r.count_(v, 3), [1, 2, 3, 2, 2]),
        (lambda v: r.std(v, 2), [None, math.sqrt(2), math.sqrt(0.5), None, None]),
        (lambda v: r.var(v, 3), [None, 2, 1, 0.5, 8]),
        (lambda v: r.med(v, 3), [10, 11, 11, 11.5, 13]),
        (lambda v: r.quantile(v, 2, 0.25), [10, 10.5, 11.25, 11, 15]),
        (lambda v: r.mad(v, 3), [0, 1, 2 / 3, 0.5, 2]),
        (lambda v: r.ema(v, 3), [10, (12 + 5) / 1.5, (11 + 6 + 2.5) / 1.75, (5.5 + 3) / 0.75, (15 + 11 / 4) / 1.25]),
        (lambda v: r.wma(v, 3), [10, (36 + 20) / 5, (33 + 24 + 10) / 6, (22 + 12) / 3, (45 + 11) / 4]),
        (lambda v: r.ts_rank(v, 3), [1, 1, 2 / 3, None, 1]),
        (lambda v: r.idx_max(v, 3), [1, 2, 2, 0, 2]),
        (lambda v: r.ref(v, 2), [None, None, 10, 12, 11]),
        (lambda v: r.delta(v, 1), [None, 2, -1, None, None]),
        (lambda v: r.period_return(v, 2), [None, None, 0.1, None, 15 / 11 - 1]),
        (lambda v: r.first_true(s.gt(v, 10), 3), [0, 1, 0, 0, 0]),
    ],
)
def test_rolling(spark, make, want):
    got = last(series(spark, V), make(F.col("v")))
    assert got == pytest.approx([None if w is None else w for w in want], nan_ok=True) if None not in want else [g if g is None else round(g, 9) for g in got] == [w if w is None else round(w, 9) for w in want]


def test_trend(spark):
    df = r.with_row_index(series(spark, [1.0, 3.0, 5.0, 8.0]))
    assert last(df, r.slope(F.col("v"), 3)) == [None, pytest.approx(2), pytest.approx(2), pytest.approx(2.5)]
    assert last(df, r.resi(F.col("v"), 3))[-1] == pytest.approx(8 - (16 / 3 + 2.5))


def test_moments(spark):
    v = [1.0, 2.0, 4.0, 9.0]
    m = sum(v) / 4
    var = sum((a - m) ** 2 for a in v) / 3
    assert last(series(spark, v), r.skew(F.col("v"), 4))[-1] == pytest.approx(sum((a - m) ** 3 for a in v) / 4 / var**1.5)
    assert last(series(spark, v), r.kurt(F.col("v"), 4))[-1] == pytest.approx(sum((a - m) ** 4 for a in v) / 4 / var**2)


def test_no_look_ahead():
    with pytest.raises(ValueError, match="look-ahead"):
        r.ref(F.lit(1), 0)


def test_scalars(spark):
    row = spark.createDataFrame([(1.0, 0.0, None)], "a double, b double, c double").select(
        s.div(F.col("a"), F.col("b")).alias("div"), s.greater(F.col("a"), F.col("c")).alias("max"), s.log_(F.col("b")).alias("log"), s.truth(F.col("c")).alias("t"),
        s.and_(F.col("a"), F.col("c")).alias("and"), s.or_(F.col("a"), F.col("c")).alias("or"), s.gt(F.col("a"), F.col("c")).alias("gt"), s.if_(F.col("c"), 1, 2).alias("if"),
    ).first()
    assert tuple(row) == (None, None, None, 0, 0, 1, None, 2.0)


def section(spark, values):
    return spark.createDataFrame([(c, DAY, float(v)) for c, v in values], "entity_code string, trade_date date, raw_value double")


def test_ranks_are_kept_apart(spark):
    df = section(spark, [("a", 1), ("b", 2), ("c", 2), ("d", 5)])
    got = df.select("entity_code", x.rank_desc("raw_value"), x.pct_rank("raw_value"), x.avg_pct_rank("raw_value"), x.rank_first("raw_value"), x.equal_count_bucket("raw_value", 2)).orderBy("entity_code").collect()
    assert [tuple(g)[1:] for g in got] == [(4, 0.0, 0.25, 4, 1), (2, 1 / 3, 0.625, 2, 2), (2, 1 / 3, 0.625, 3, 1), (1, 1.0, 1.0, 1, 2)]


def test_constant_section_scores_zero(spark):
    df = job.post_process(section(spark, [("a", 3), ("b", 3)]), clip="mad")
    assert [row["score"] for row in df.collect()] == [0.0, 0.0]


def test_not_finite_is_dropped(spark):
    df = section(spark, [("a", 1), ("b", float("nan")), ("c", float("inf"))])
    assert [row["entity_code"] for row in x.finite(df).collect()] == ["a"]


def panel(spark, n=40):
    rows = []
    for e in range(3):
        pre = None
        for i in range(n):
            close = 10 + e + math.sin(i * (e + 1)) + i / 10
            rows.append((f"00000{e}.SZ", DAY + dt.timedelta(i), close - 0.2, close + 0.5, close - 0.6, close, 100.0 + i * e, 1000.0 + i, pre, None if pre is None else (close / pre - 1) * 100, 0.1 + i / 100, 12.0, 1.5, None if pre is None else pre * 1.1))
            pre = close
    return spark.createDataFrame(rows, "entity_code string, trade_date date, open double, high double, low double, close double, volume double, amount double, pre_close double, pct_chg double, turnover_rate double, pe double, pb double, high_limited double")


def test_catalogue_is_complete(spark):
    assert [len(g) for g in (catalog.SEED, catalog.STYLE, catalog.SENTIMENT, catalog.RISK, catalog.TECHNICAL, catalog.MOMENTUM)] == [7, 6, 28, 12, 13, 25]
    assert len(catalog.NESTED) == 15 and len(catalog.AMBIGUOUS) == 9
    wide = r.with_row_index(panel(spark)).select(*[c.alias(n) for n, c in catalog.columns(list(catalog.FLAT)).items()])
    assert wide.count() == 120


@pytest.mark.parametrize("name", sorted(catalog.NESTED))
def test_nested_factors(spark, name):
    p = panel(spark)
    got = catalog.factor(name)(p)
    assert got.columns == [*p.columns, "raw_value"]
    assert got.count() == 120


def test_range_does_not_depend_on_later_data(spark):
    p = panel(spark)
    make = catalog.factor("MAC5")
    whole = job.compute_factor(p, make, "2024-01-20", "2024-01-25", 5)
    cut = job.compute_factor(p.where("trade_date <= '2024-01-25'"), make, "2024-01-20", "2024-01-25", 5)
    parts = job.compute_factor(p, make, "2024-01-20", "2024-01-22", 5).unionByName(job.compute_factor(p, make, "2024-01-23", "2024-01-25", 5))
    order = ["trade_date", "entity_code"]
    assert whole.orderBy(*order).collect() == cut.orderBy(*order).collect() == parts.orderBy(*order).collect()


def test_feature_matrix_needs_coverage(spark):
    p = panel(spark)
    members = p.select("entity_code", "trade_date")
    assert job.feature_matrix(members, p, ["MAC5", "ROC6"]).count() == 120
    with pytest.raises(ValueError, match="coverage"):
        job.feature_matrix(members, p, ["ROC60"])
