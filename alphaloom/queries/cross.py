"""Queries of cross-sectional post-processing and of whole factor jobs."""

from pyspark.sql import functions as F

from ..functions import catalog
from ..functions import rolling as r
from ..operators import cross_section as x
from ..operators.quality import quality
from ..operators.reports import value_status
from ..plans import factor_job as job
from .base import PANEL, ROWS, Registry, panel

R = Registry()
K = "entity_code trade_date"
c = F.col

RAW = f"""{PANEL}, raw AS (SELECT entity_code, trade_date, close / nullif(lag(close, 4) OVER o, 0) - 1 AS raw_value FROM panel WINDOW o AS {ROWS}),
fin AS (SELECT * FROM raw WHERE raw_value IS NOT NULL AND isfinite(raw_value))"""


def raw(spark, sf):
    return panel(spark, sf).select("entity_code", "trade_date", r.period_return(c("close"), 4).alias("raw_value"))


@R.add("x_finite", K, "raw_value", sql=f"WITH {RAW} SELECT * FROM fin")
def _(spark, sf):
    return x.finite(raw(spark, sf))


@R.add("x_winsorize_quantile", K, "processed", sql=f"""
WITH {RAW}, e AS (SELECT trade_date, quantile_cont(raw_value, 0.05) AS lo, quantile_cont(raw_value, 0.95) AS hi FROM fin GROUP BY 1)
SELECT *, least(greatest(raw_value, lo), hi) AS processed FROM fin JOIN e USING (trade_date)""")
def _(spark, sf):
    return x.winsorize_quantile(x.finite(raw(spark, sf)), 0.05, 0.95)


_MAD = f"""WITH {RAW}, m AS (SELECT trade_date, quantile_cont(raw_value, 0.5) AS m FROM fin GROUP BY 1),
s AS (SELECT trade_date, quantile_cont(abs(raw_value - m), 0.5) AS s FROM fin JOIN m USING (trade_date) GROUP BY 1)
SELECT *, CASE WHEN s > 0 THEN least(greatest(raw_value, m - {{w}} * 1.4826 * s), m + {{w}} * 1.4826 * s) ELSE raw_value END AS processed FROM fin JOIN m USING (trade_date) JOIN s USING (trade_date)"""


@R.add("x_winsorize_mad", K, "processed", sql=_MAD.format(w=3))
def _(spark, sf):
    return x.winsorize_mad(x.finite(raw(spark, sf)))


@R.add("x_winsorize_median", K, "processed", sql=_MAD.format(w=5))
def _(spark, sf):
    return x.winsorize_median(x.finite(raw(spark, sf)))


@R.add("x_ranks", K, "pct zscore avg_pct stock_score group_score", "rank first_rank", sql=f"""
WITH {RAW}, a AS (SELECT *, rank() OVER (d ORDER BY raw_value DESC) AS rank, percent_rank() OVER (d ORDER BY raw_value) AS pct, stddev_pop(raw_value) OVER d AS s, avg(raw_value) OVER d AS mu,
 (rank() OVER (d ORDER BY raw_value) + (count(*) OVER (PARTITION BY trade_date, raw_value) - 1) / 2.0) / count(*) OVER d AS avg_pct, count(*) OVER d AS n,
 row_number() OVER (d ORDER BY raw_value DESC, entity_code) AS first_rank FROM fin WINDOW d AS (PARTITION BY trade_date))
SELECT *, CASE WHEN s > 0 THEN (raw_value - mu) / s ELSE 0 END AS zscore, 2 * avg_pct - 1 AS stock_score, CASE WHEN n > 1 THEN 1 - 2.0 * (first_rank - 1) / (n - 1) ELSE 0 END AS group_score FROM a""")
def _(spark, sf):
    return x.finite(raw(spark, sf)).withColumns({
        "rank": x.rank_desc("raw_value"), "pct": x.pct_rank("raw_value"), "zscore": x.zscore("raw_value"), "avg_pct": x.avg_pct_rank("raw_value"), "first_rank": x.rank_first("raw_value"),
        "stock_score": x.rank_score("raw_value"), "group_score": x.rank_score("raw_value", "group"),
    })


@R.add("x_buckets", K, "", "bucket", sql=f"""
WITH {RAW} SELECT *, floor((row_number() OVER (PARTITION BY trade_date ORDER BY raw_value, entity_code DESC) - 1) * 5 / count(*) OVER (PARTITION BY trade_date)) + 1 AS bucket FROM fin""")
def _(spark, sf):
    return x.finite(raw(spark, sf)).withColumn("bucket", x.equal_count_bucket("raw_value", 5))


_JOB = f"""WITH {RAW}, cut AS (SELECT * FROM fin WHERE trade_date BETWEEN DATE '1996-01-01' AND DATE '1999-12-31'),
e AS (SELECT trade_date, quantile_cont(raw_value, 0.01) AS lo, quantile_cont(raw_value, 0.99) AS hi FROM cut GROUP BY 1),
p AS (SELECT *, least(greatest(raw_value, lo), hi) AS processed FROM cut JOIN e USING (trade_date)),
r AS (SELECT *, rank() OVER (d ORDER BY processed DESC) AS rank_value, percent_rank() OVER (d ORDER BY processed) AS percentile, stddev_pop(processed) OVER d AS s, avg(processed) OVER d AS mu FROM p WINDOW d AS (PARTITION BY trade_date))
SELECT *, CASE WHEN s > 1e-12 THEN (processed - mu) / s ELSE 0 END AS score FROM r"""


@R.add("factor_job", K, "raw_value processed percentile score", "rank_value", sql=_JOB)
def factor_job(spark, sf):
    make = lambda p: p.withColumn("raw_value", r.period_return(c("close"), 4))
    return job.compute_factor(panel(spark, sf), make, "1996-01-01", "1999-12-31", 52)


def _scored(spark, sf, mode):
    make = lambda p: p.withColumn("raw_value", r.period_return(c("close"), 4))
    return job.compute_factor(panel(spark, sf), make, "1996-01-01", "1999-12-31", 52, mode=mode)


@R.add("factor_scores", K + " mode", "processed score", sql=f"WITH j AS ({_JOB}) SELECT *, 'rank' AS mode FROM (SELECT * REPLACE (percentile AS score) FROM j) UNION ALL SELECT *, 'none' FROM (SELECT * REPLACE (processed AS score) FROM j)")
def _(spark, sf):
    """The scores of a job that ranks, and of one that leaves values as they are."""
    return _scored(spark, sf, "rank").withColumn("mode", F.lit("rank")).unionByName(_scored(spark, sf, "none").withColumn("mode", F.lit("none")))


@R.add("v_status", "status warnings", sql=f"""
WITH q AS (SELECT *, CASE WHEN trade_date < DATE '1998-01-01' THEN score END AS kept_score FROM ({_JOB})), u AS (SELECT count(*) AS n, count(raw_value) AS r, count(*) FILTER (raw_value = 0) AS z, [count(rank_value), count(percentile), count(kept_score)] AS p FROM q),
w AS (SELECT *, CASE WHEN n = 0 THEN 'empty' WHEN list_sum(p) = 0 THEN 'not_generated' WHEN list_min(p) = n THEN 'generated' ELSE 'partial' END AS status FROM u)
SELECT status, list_filter([CASE WHEN n = 0 THEN 'no_values' END, CASE WHEN n > 0 AND r = 0 THEN 'all_null' END, CASE WHEN r > 0 AND z = r THEN 'all_zero' END, CASE WHEN status = 'not_generated' THEN 'not_processed' END, CASE WHEN status = 'partial' THEN 'partly_processed' END], lambda x: x IS NOT NULL) AS warnings FROM w""")
def _(spark, sf):
    """Of values whose later dates were never scored."""
    values = factor_job(spark, sf).withColumn("score", F.when(c("trade_date") < "1998-01-01", c("score")))
    return value_status(quality(values, ["raw_value", "rank_value", "percentile", "score"]))


@R.add("factor_boolean", K, "raw_value score", "rank_value", sql=f"""
WITH {PANEL}, v AS (SELECT entity_code, trade_date, (pct_chg > 10)::INT::DOUBLE AS raw_value FROM panel WHERE pct_chg IS NOT NULL AND isfinite(pct_chg))
SELECT *, raw_value AS score, rank() OVER (PARTITION BY trade_date ORDER BY raw_value DESC) AS rank_value FROM v""")
def _(spark, sf):
    p = panel(spark, sf).withColumn("raw_value", (c("pct_chg") > 10).cast("double"))
    return job.post_process(p.select("entity_code", "trade_date", "raw_value"), boolean=True)


@R.add("field_feature", K, "raw_value processed score", sql=f"""
WITH {PANEL}, v AS (SELECT entity_code, trade_date, pe AS raw_value FROM panel WHERE pe IS NOT NULL),
e AS (SELECT trade_date, quantile_cont(raw_value, 0.01) AS lo, quantile_cont(raw_value, 0.99) AS hi FROM v GROUP BY 1),
p AS (SELECT *, least(greatest(raw_value, lo), hi) AS processed FROM v JOIN e USING (trade_date))
SELECT *, CASE WHEN stddev_pop(processed) OVER d > 1e-9 THEN (processed - avg(processed) OVER d) / stddev_pop(processed) OVER d ELSE 0 END AS score FROM p WINDOW d AS (PARTITION BY trade_date)""")
def _(spark, sf):
    return job.field_feature(panel(spark, sf), "pe")


# --- the catalogue, by group ---

_Q = {n: f"(PARTITION BY entity_code ORDER BY trade_date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)" for n in (3, 5, 6, 10, 12, 13, 14, 15, 20, 21, 24, 25, 26, 60, 61, 63, 120, 240, 250, 252)}
_WINDOWS = "WINDOW o AS " + ROWS + ", " + ", ".join(f"w{n} AS {q}" for n, q in _Q.items())


def _ema(x: str, n: int) -> str:
    a = 1 - 2 / (n + 1)
    return f"(list_sum(list_transform(list_reverse(list({x}) OVER w{n}), lambda y, i: y * pow({a}, i - 1))) / list_sum(list_transform(list_reverse(list({x}) OVER w{n}), lambda y, i: CASE WHEN y IS NOT NULL THEN pow({a}, i - 1) END)))"


def _bal(a: str, b: str, d: str, e: str) -> str:
    return f"sum(CASE WHEN {a} - {b} IS NOT NULL THEN greatest({a} - {b}, 0) END) OVER w26 / nullif(sum(CASE WHEN {d} - {e} IS NOT NULL THEN greatest({d} - {e}, 0) END) OVER w26, 0) * 100"


def _std(x: str, n: int) -> str:
    return f"stddev_samp({x}) OVER w{n}"


_LIMIT = "(coalesce(high_limited, 0) > 0 AND coalesce(close >= high_limited, FALSE))::INT"
_TR = "CASE WHEN pre_close IS NOT NULL THEN greatest(high - low, abs(high - pre_close), abs(low - pre_close)) END"
_TYP = "((high + low + close) / 3)"
_D = "(pct_chg / 100)"
_VR = lambda op: f"sum(CASE WHEN pct_chg {op} 0 THEN volume ELSE 0 END) OVER w26"
_AR, _BR = _bal("high", "open", "open", "low"), _bal("high", "pre_close", "pre_close", "low")

CATALOG_SQL = {
    "seed": {
        "mean_volume": "avg(volume) OVER w20", "mean_amount": "avg(amount) OVER w20", "mean_turnover_rate": "avg(turnover_rate) OVER w20", "period_return": "close / nullif(lag(close, 20) OVER o, 0) - 1",
        "limit_up_count": f"sum({_LIMIT}) OVER w20",
        "first_limit_up_window": f"({_LIMIT} = 1 AND coalesce(sum({_LIMIT}) OVER (PARTITION BY entity_code ORDER BY trade_date ROWS BETWEEN 59 PRECEDING AND 1 PRECEDING), 0) = 0)::INT",
        "stock_fear_proxy": f"0.35 * {_std('pct_chg', 20)} + 0.3 * sqrt(avg(pow(CASE WHEN pct_chg IS NOT NULL THEN least(pct_chg, 0) END, 2)) OVER w20) + 0.2 * (CASE WHEN lag(close, 5) OVER o IS NOT NULL THEN greatest(-100 * (close / lag(close, 5) OVER o - 1), 0) END) + 1.5 * greatest(volume / nullif(avg(volume) OVER w20, 0) - 1, 0)",
    },
    "style": {
        "average_share_turnover_annual": "ln(sum(turnover_rate) OVER w252 / 12)", "average_share_turnover_quarterly": "ln(sum(turnover_rate) OVER w63 / 3)", "share_turnover_monthly": "ln(sum(turnover_rate) OVER w21)",
        "book_to_price_ratio": "1 / nullif(pb, 0)", "earnings_to_price_ratio": "1 / nullif(pe, 0)", "btop": "1 / nullif(pb, 0)",
    },
    "sentiment": {
        "AR": _AR, "BR": _BR, "ARBR": f"({_AR}) - ({_BR})", **{f"ATR{n}": f"avg({_TR}) OVER w{n}" for n in (6,)},
        **{f"DAVOL{n}": f"avg(turnover_rate) OVER w{n} / nullif(avg(turnover_rate) OVER w120, 0)" for n in (5, 10, 20)}, "PSY": "sum((pct_chg > 0)::INT) OVER w12 / 12.0 * 100",
        "turnover_volatility": _std("turnover_rate", 20), **{f"TVMA{n}": f"avg(amount) OVER w{n}" for n in (6, 20)}, **{f"TVSTD{n}": _std("amount", n) for n in (6, 20)},
        "VDIFF": f"{_ema('volume', 12)} - {_ema('volume', 26)}", **{f"VOL{n}": f"avg(turnover_rate) OVER w{n}" for n in (5, 10, 20, 60, 120, 240)},
        "VOSC": f"({_ema('volume', 12)} - {_ema('volume', 26)}) / {_ema('volume', 12)} * 100", "VR": f"({_VR('>')} + 0.5 * {_VR('=')}) / nullif({_VR('<')} + 0.5 * {_VR('=')}, 0)",
        **{f"VROC{n}": f"(volume / nullif(lag(volume, {n}) OVER o, 0) - 1) * 100" for n in (6, 12)}, **{f"VSTD{n}": _std("volume", n) for n in (10, 20)},
        "WVAD": "sum((close - open) / nullif(high - low, 0) * volume) OVER w6",
    },
    "risk": {
        **{f"Variance{n}": f"var_samp({_D}) OVER w{n}" for n in (20, 60, 120)},
        **{f"sharpe_ratio_{n}": f"(avg({_D}) OVER w{n} * 252 - 0.04) / nullif({_std(_D, n)} * sqrt(252), 0)" for n in (20, 60, 120)},
    },
    "technical": {
        "boll_up": f"(avg(close) OVER w20 + 2 * {_std('close', 20)}) / nullif(close, 0)", "boll_down": f"(avg(close) OVER w20 - 2 * {_std('close', 20)}) / nullif(close, 0)",
        "EMA5": f"{_ema('close', 5)} / close", **{f"EMAC{n}": f"{_ema('close', n)} / close" for n in (10, 12, 20, 26, 120)}, **{f"MAC{n}": f"avg(close) OVER w{n} / close" for n in (5, 10, 20, 60, 120)},
    },
    "momentum": {
        "arron_up_25": "(len(list(high) OVER w25) - list_position(list_reverse(list(high) OVER w25), max(high) OVER w25) + 1) / 25.0 * 100",
        "arron_down_25": "(len(list(low) OVER w25) - list_position(list_reverse(list(low) OVER w25), min(low) OVER w25) + 1) / 25.0 * 100",
        "BBIC": "(avg(close) OVER w3 + avg(close) OVER w6 + avg(close) OVER w12 + avg(close) OVER w24) / 4 / close", **{f"BIAS{n}": f"(close - avg(close) OVER w{n}) / avg(close) OVER w{n} * 100" for n in (5, 10, 20, 60)},
        "bull_power": f"(high - {_ema('close', 13)}) / close", "bear_power": f"(low - {_ema('close', 13)}) / close",
        **{f"CCI{n}": f"({_TYP} - avg({_TYP}) OVER w{n}) / nullif(0.015 * list_avg(list_transform(list({_TYP}) OVER w{n}, lambda y: abs(y - list_avg(list({_TYP}) OVER w{n})))), 0)" for n in ()},
        **{f"PLRC{n}": f"CASE WHEN count(*) OVER w{n} > 1 THEN regr_slope(close, nth::DOUBLE) OVER w{n} / avg(close) OVER w{n} END" for n in (6, 12, 24)},
        **{f"Price{k}": f"close / avg(close) OVER w{n} - 1" for k, n in (("1M", 21), ("3M", 61), ("1Y", 250))}, **{f"ROC{n}": f"(close / lag(close, {n}) OVER o - 1) * 100" for n in (6, 12, 20)},
        "single_day_VPT": f"{_D} * volume", **{f"single_day_VPT_{n}": f"avg({_D} * volume) OVER w{n}" for n in (6, 12)}, "Volume1M": f"volume / avg(volume) OVER w20 * avg({_D}) OVER w20",
    },
    "ambiguous": {
        "money_flow_20": f"avg({_TYP} * volume) OVER w20", **{f"VEMA{n}": _ema("volume", n) for n in (5, 10, 12, 26)}, "price_no_fq": "close",
        **{f"ROC{n}": f"(close / lag(close, {n}) OVER o - 1) * 100" for n in (60, 120)},
    },
}


def _catalog(group: str) -> None:
    exprs = CATALOG_SQL[group]
    select = ", ".join(f"{e} AS {n}" for n, e in exprs.items())
    names = list(exprs)

    @R.add(f"catalog_{group}", K, " ".join(names), sql=f"WITH {PANEL}, q AS (SELECT entity_code, trade_date, {select} FROM panel {_WINDOWS}) SELECT * FROM q")
    def _(spark, sf):
        return r.with_row_index(panel(spark, sf)).select("entity_code", "trade_date", *[v.alias(n) for n, v in catalog.columns(names).items()])


for _group in CATALOG_SQL:
    _catalog(_group)


def _moment(n: int, k: int) -> str:
    """The k-th central moment of the window's daily returns over the sample variance to the power k / 2."""
    m = lambda j: f"list_sum(list_transform(d{n}, lambda x: pow(x - m{n}, {j})))"
    return f"CASE WHEN n{n} > 1 AND {m(2)} > 0 THEN ({m(k)} / n{n}) / pow({m(2)} / (n{n} - 1), {k / 2}) END"


#: What needs the values of its window as a list: these first, then the factors over them.
_LISTS = {
    "risk": ", ".join(f"list({_D}) OVER w{n} AS d{n}, avg({_D}) OVER w{n} AS m{n}, count({_D}) OVER w{n} AS n{n}" for n in (20, 60, 120)),
    "momentum": f"{_TYP} AS typ, " + ", ".join(f"list({_TYP}) OVER w{n} AS t{n}, avg({_TYP}) OVER w{n} AS m{n}" for n in (10, 15, 20)),
    "ambiguous": "close, list(close) OVER w250 AS c250, count(close) OVER w250 AS n250",
    "sentiment": f"avg({_TR}) OVER w14 AS a14",
}
REST_SQL = {
    "risk": {f"{name}{n}": _moment(n, k) for name, k in (("Kurtosis", 4), ("Skewness", 3)) for n in (20, 60, 120)},
    "momentum": {f"CCI{n}": f"(typ - m{n}) / nullif(0.015 * list_avg(list_transform(t{n}, lambda y: abs(y - m{n}))), 0)" for n in (10, 15, 20)},
    "ambiguous": {"fifty_two_week_close_rank": "1 - len(list_filter(c250, lambda y: y <= close)) / n250::DOUBLE"},
    "sentiment": {"ATR14": "a14"},
}


def _catalog_rest(group: str, names: list[str]) -> None:
    """The factors of a group that CATALOG_SQL lacks; tests/test_catalog.py checks them by brute force as well."""
    select = ", ".join(f"{e} AS {n}" for n, e in REST_SQL[group].items())
    sql = f"WITH {PANEL}, q AS (SELECT entity_code, trade_date, {_LISTS[group]} FROM panel {_WINDOWS}) SELECT entity_code, trade_date, {select} FROM q"

    @R.add(f"catalog_{group}_rest", K, " ".join(names), sql=sql if set(names) == set(REST_SQL[group]) else None)
    def _(spark, sf):
        lagged = [n for n in names if n in catalog.MOMENTS]
        flat = catalog.columns([n for n in names if n not in lagged])
        if not flat:
            return catalog.nested(panel(spark, sf).select("entity_code", "trade_date", "pct_chg"), lagged)
        wide = r.with_row_index(catalog.nested(panel(spark, sf), lagged))
        return wide.select("entity_code", "trade_date", *[v.alias(n) for n, v in flat.items()], *lagged)


for _group, _exprs in CATALOG_SQL.items():
    if _names := [n for n in catalog.GROUPS[_group] if n not in _exprs]:
        _catalog_rest(_group, _names)


@R.add("catalog_nested", K, " ".join(catalog.NESTED))
def _(spark, sf):
    return catalog.nested(panel(spark, sf).select("entity_code", "trade_date", "open", "high", "low", "close", "volume", "pct_chg"))


@R.add("catalog_probe", "factor_id", "", "rows finite")
def _(spark, sf):
    return job.probe_catalog(panel(spark, sf))
