"""Factors of the catalogue that have no SQL, over a whole panel against brute force."""

import datetime as dt
import math
import random

import pytest

from alphaloom.functions import catalog
from alphaloom.functions import rolling as r
from alphaloom.plans import factor_job as job
from alphaloom.queries import cross

SF = "/root/testdata/sf0.001"
SCHEMA = "entity_code string, trade_date date, open double, high double, low double, close double, volume double, pre_close double, pct_chg double"
REST = [n for g, exprs in cross.CATALOG_SQL.items() for n in catalog.GROUPS[g] if n not in exprs]


def panel_rows(n=270):
    rng, rows = random.Random(4), []
    for e in "ABC":
        close = None
        for i in range(n):
            pre, close = close, (close or 20) * math.exp(rng.gauss(0, 0.03))
            high, low = close * (1 + rng.random() / 20), close * (1 - rng.random() / 20)
            if i % 50 == 7:
                high = low = close
            volume = None if i % 41 == 5 else float(rng.randrange(100, 1000))
            rows.append((e, dt.date(2020, 1, 1) + dt.timedelta(i), low + (high - low) * rng.random(), high, low, close, volume, pre, None if pre is None else (close / pre - 1) * 100))
    return rows


def each(*xs):
    """Row by row, null where one is."""
    *xs, f = xs
    return [None if None in v else f(*v) for v in zip(*xs, strict=True)]


def rolled(x, n, f, least=1):
    frames = ([v for v in x[max(0, i - n + 1) : i + 1] if v is not None] for i in range(len(x)))
    return [f(v) if len(v) >= least else None for v in frames]


def mean(v):
    return sum(v) / len(v)


def weighted(x, n, weight):
    out = []
    for i in range(len(x)):
        terms = [(weight(k), x[i - k]) for k in range(min(n, i + 1)) if x[i - k] is not None]
        out.append(sum(w * v for w, v in terms) / sum(w for w, _ in terms) if terms else None)
    return out


def ema(x, n):
    return weighted(x, n, lambda k: (1 - 2 / (n + 1)) ** k)


def half(x, n, days):
    return weighted(x, n, lambda k: 0.5 ** (k / days))


def ref(x, n):
    return [None] * min(n, len(x)) + x[: max(0, len(x) - n)]


def ratio(a, b):
    return each(a, b, lambda p, q: p / q if q else None)


def moment(x, n, p):
    def f(v):
        m, var = mean(v), sum((y - mean(v)) ** 2 for y in v) / (len(v) - 1)
        return mean([(y - m) ** p for y in v]) / var ** (p / 2)

    return rolled(x, n, f, 2)


def plainly(rows):
    """name -> values of one entity's rows, without Rank1M."""
    o, h, l, c, v, pre, pct = (list(x) for x in list(zip(*rows, strict=True))[2:])
    d = each(pct, lambda p: p / 100)
    tp = each(h, l, c, lambda a, b, e: (a + b + e) / 3)
    log = each(d, lambda x: math.log(1 + x))
    out = {"ATR14": rolled(each(h, l, pre, lambda a, b, p: max(a - b, abs(a - p), abs(b - p))), 14, mean)}
    for n in (20, 60, 120):
        out[f"Kurtosis{n}"], out[f"Skewness{n}"] = moment(d, n, 4), moment(d, n, 3)
    for n in (10, 15, 20, 88):
        spread = rolled(tp, n, lambda x: 0.015 * mean([abs(y - mean(x)) for y in x]))
        out[f"CCI{n}"] = ratio(each(tp, rolled(tp, n, mean), lambda a, b: a - b), spread)
    out["fifty_two_week_close_rank"] = rolled(c, 250, lambda x: 1 - mean([y <= x[-1] for y in x]))

    def macd(x):
        dif = each(ema(x, 12), ema(x, 26), lambda a, b: a - b)
        return dif, ema(dif, 9)

    dif, dea = macd(c)
    out["MACDC"] = each(dif, dea, c, lambda a, b, e: 2 * (a - b) / e)
    dif, out["VDEA"] = macd(v)
    out["VMACD"] = each(dif, out["VDEA"], lambda a, b: 2 * (a - b))
    term = each(ratio(each(c, o, lambda a, b: a - b), each(h, l, lambda a, b: a - b)), v, lambda a, b: a * b)
    out["MAWVAD"] = rolled(rolled(term, 6, sum), 6, mean)
    for n in (5, 10):
        three = ema(ema(ema(c, n), n), n)
        out[f"TRIX{n}"] = each(three, ref(three, 1), lambda a, b: (a / b - 1) * 100)
    e = ema(each(h, l, lambda a, b: a - b), 9)
    out["MASS"] = rolled(ratio(e, ema(e, 9)), 25, sum)
    mid = ref(each(h, l, lambda a, b: (a + b) / 2), 1)
    up, down = (rolled(each(a, b, lambda x, y: max(x - y, 0)), 20, sum) for a, b in ((h, mid), (mid, l)))
    out["CR20"] = each(ratio(up, down), lambda x: x * 100)
    flow, move = each(tp, v, lambda a, b: a * b), each(tp, ref(tp, 1), lambda a, b: a - b)
    up, down = (rolled([f if m is not None and sign * m > 0 else 0.0 for f, m in zip(flow, move, strict=True)], 14, sum) for sign in (1, -1))
    out["MFI14"] = each(ratio(up, down), lambda x: 100 - 100 / (1 + x))
    m, square = half(d, 252, 42), half(each(d, lambda x: x * x), 252, 42)
    out["daily_standard_deviation"] = each(m, square, lambda a, b: math.sqrt(max(b - a * a, 0)))
    out["momentum"], out["relative_strength"] = half(ref(log, 21), 504, 126), half(log, 504, 126)
    z = [each(c, ref(c, 21 * k), lambda a, b: math.log(a / b)) for k in range(1, 13)]
    out["cumulative_range"] = [max(x) - min(x) if (x := [y for y in row if y is not None]) else None for row in zip(*z, strict=True)]
    return out


def test_factors_without_sql(spark):
    rows = panel_rows()
    panel = spark.createDataFrame(rows, SCHEMA)
    flat = r.with_row_index(panel).select("entity_code", "trade_date", *[v.alias(n) for n, v in catalog.columns(REST).items()])
    wide = {(x["entity_code"], x["trade_date"]): x.asDict() for x in flat.collect()}
    for x in catalog.nested(panel).select("entity_code", "trade_date", *catalog.NESTED).collect():
        wide[x["entity_code"], x["trade_date"]] |= x.asDict()
    back = {}
    for entity in "ABC":
        own = [x for x in rows if x[0] == entity]
        close = [x[5] for x in own]
        back |= {(x[0], x[1]): y for x, y in zip(own, each(close, ref(close, 20), lambda a, b: a / b - 1), strict=True)}
        want = plainly(own)
        assert {*want, "Rank1M"} == {*REST, *catalog.NESTED}
        for name, values in want.items():
            for x, y in zip(own, values, strict=True):
                g = wide[x[0], x[1]][name]
                g = None if g is None or math.isnan(g) else g
                assert g == (None if y is None else pytest.approx(y, rel=1e-7, abs=1e-9)), (name, x[1])
    for (entity, day), mine in back.items():
        others = [y for (_, d), y in back.items() if d == day and y is not None]
        assert wide[entity, day]["Rank1M"] == (None if mine is None else pytest.approx((1 + sum(y > mine for y in others)) / len(others)))


def test_queries_return_every_factor(spark):
    got = {n for q, make in cross.R.queries.items() if q.startswith("catalog_") and q != "catalog_probe" for n in make(spark, SF).columns}
    assert got == {"entity_code", "trade_date", *catalog.FLAT, *catalog.NESTED}


def test_probe_counts_all_entities_and_factors(spark):
    rows = panel_rows(60)
    more = ["turnover_rate", "amount", "pe", "pb", "high_limited"]
    panel = spark.createDataFrame(rows, SCHEMA).selectExpr("*", *[f"close AS {x}" for x in more])
    got = {x["factor_id"]: (x["rows"], x["finite"]) for x in job.probe_catalog(panel).collect()}
    assert set(got) == {*catalog.FLAT, *catalog.NESTED}
    assert {n for n, _ in got.values()} == {180}
    assert got["MAC5"][1] == 180 and got["Rank1M"][1] == 3 * 40 and got["TRIX5"][1] == 3 * 59
