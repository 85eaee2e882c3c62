"""Queries of the scalar and rolling functions."""

from pyspark.sql import functions as F

from ..functions import rolling as r
from ..functions import scalar as s
from .base import CODED, PANEL, ROWS, Registry, coded, over, panel

R = Registry()
K = "entity_code trade_date"
c = F.col


@R.add("f_arithmetic", K, "added subtracted multiplied divided negated", sql=f"""
WITH {PANEL} SELECT *, close + open AS added, close - open AS subtracted, close * volume AS multiplied, close / nullif(k % 5, 0) AS divided, -close AS negated FROM panel""")
def _(spark, sf):
    p = panel(spark, sf)
    k = F.substring_index("entity_code", ".", 1).cast("double") % 5
    return p.withColumns({"added": s.add(c("close"), c("open")), "subtracted": s.sub(c("close"), c("open")), "multiplied": s.mul(c("close"), c("volume")), "divided": s.div(c("close"), k), "negated": s.neg(c("close"))})


@R.add("f_pairwise", K, "larger smaller", sql=f"""
WITH {PANEL} SELECT *, CASE WHEN pre_close IS NOT NULL THEN greatest(close, pre_close) END AS larger, CASE WHEN pre_close IS NOT NULL THEN least(close, pre_close) END AS smaller FROM panel""")
def _(spark, sf):
    return panel(spark, sf).withColumns({"larger": s.greater(c("close"), c("pre_close")), "smaller": s.less(c("close"), c("pre_close"))})


@R.add("f_math", K, "absolute signed logged powered", sql=f"""
WITH {PANEL} SELECT *, abs(pct_chg) AS absolute, sign(pct_chg) AS signed, CASE WHEN pct_chg > 0 THEN ln(pct_chg) END AS logged, pow(turnover_rate, 1.5) AS powered FROM panel""")
def _(spark, sf):
    return panel(spark, sf).withColumns({"absolute": s.abs_(c("pct_chg")), "signed": s.sign(c("pct_chg")), "logged": s.log_(c("pct_chg")), "powered": s.power(c("turnover_rate"), 1.5)})


@R.add("f_nulls", K, "nulled filled", "missing", sql=f"""
WITH {PANEL} SELECT *, nullif(is_st, 1) AS nulled, coalesce(pre_close, -1) AS filled, (pre_close IS NULL)::INT AS missing FROM panel""")
def _(spark, sf):
    return panel(spark, sf).withColumns({"nulled": s.null_if(c("is_st"), 1), "filled": s.fill_na(c("pre_close"), -1), "missing": s.is_null(c("pre_close"))})


@R.add("f_logic", K, "chosen", "g ge l le e n conj disj inverse holds", sql=f"""
WITH {PANEL} SELECT *, CASE WHEN pct_chg > 0 THEN volume ELSE 0 END AS chosen, (close > pre_close)::INT AS g, (close >= pre_close)::INT AS ge, (close < pre_close)::INT AS l,
 (close <= pre_close)::INT AS le, (is_st = 0)::INT AS e, (is_st <> 0)::INT AS n, (is_st <> 0 AND coalesce(pct_chg, 0) <> 0)::INT AS conj, (is_st <> 0 OR coalesce(pct_chg, 0) <> 0)::INT AS disj,
 (is_st = 0)::INT AS inverse, (coalesce(pct_chg, 0) <> 0)::INT AS holds FROM panel""")
def _(spark, sf):
    a, b = c("close"), c("pre_close")
    return panel(spark, sf).withColumns({
        "chosen": s.if_(s.gt(c("pct_chg"), 0), c("volume"), 0), "g": s.gt(a, b), "ge": s.ge(a, b), "l": s.lt(a, b), "le": s.le(a, b), "e": s.eq(c("is_st"), 0), "n": s.ne(c("is_st"), 0),
        "conj": s.and_(c("is_st"), c("pct_chg")), "disj": s.or_(c("is_st"), c("pct_chg")), "inverse": s.not_(c("is_st")), "holds": s.truth(c("pct_chg")),
    })


@R.add("f_board", "entity_code code listed name", "", "main growth", sql=f"""
WITH {PANEL}, e AS (SELECT DISTINCT entity_code, {CODED} AS code FROM panel)
SELECT *, CASE WHEN code LIKE '%.BJ' THEN 'Beijing' WHEN code LIKE '688%.SH' THEN 'STAR' WHEN code LIKE '300%.SZ' THEN 'ChiNext' ELSE 'Main' END AS listed,
 CASE left(code, 3) WHEN '688' THEN '科创板' WHEN '300' THEN '创业板' WHEN '430' THEN CASE WHEN len(split_part(code, '.', 1)) = 6 THEN '北交所' ELSE '其他' END WHEN '900' THEN '其他' ELSE '沪深主板' END AS name,
 (left(code, 3) IN ('600', '001'))::INT AS main, (left(code, 3) IN ('688', '300'))::INT AS growth FROM e""")
def _(spark, sf):
    codes = panel(spark, sf).select("entity_code").distinct().withColumn("code", coded())
    return codes.withColumns({"listed": s.board(c("code")), "name": s.board_name(c("code")), "main": s.is_main_board(c("code")), "growth": s.is_growth_board(c("code"))})


@R.add("f_bands", K + " bucket band state regime advice", sql=f"""
WITH {PANEL} SELECT *, CASE WHEN v IS NULL THEN '未知' WHEN v < 3e9 THEN '微盘' WHEN v < 1e10 THEN '小盘' WHEN v < 3e10 THEN '中盘' WHEN v < 1e11 THEN '大盘' ELSE '超大盘' END AS bucket,
 CASE WHEN x <= -0.25 THEN '≤-0.25' WHEN x <= -0.2 THEN '-0.25~-0.20' WHEN x <= -0.15 THEN '-0.20~-0.15' WHEN x <= -0.1 THEN '-0.15~-0.10' WHEN x <= -0.06 THEN '-0.10~-0.06' END AS band,
 CASE WHEN x IS NULL THEN NULL WHEN x < 0.06 THEN '熊市' WHEN x < 0.09 THEN '震荡偏弱' WHEN x < 0.1 THEN '震荡' WHEN x < 0.12 THEN '震荡偏强' ELSE '牛市' END AS state,
 CASE WHEN x IS NULL THEN 'unknown' WHEN x >= 0.2 THEN 'strong_bull' WHEN x >= 0.05 THEN 'bull' WHEN x <= -0.1 THEN 'bear' ELSE 'sideways' END AS regime,
 CASE WHEN x IS NULL THEN NULL WHEN x >= 0.12 AND k % 9 >= 5 THEN '100%' WHEN x >= 0.1 AND k % 9 >= 3 THEN '50%' WHEN x >= 0.09 AND k % 9 >= 2 THEN '30%' WHEN x >= 0.06 THEN '0-30%' ELSE '0%' END AS advice
FROM (SELECT *, pct_chg / 400 AS x, pre_close * volume * 1e5 AS v FROM panel)""")
def _(spark, sf):
    x = c("pct_chg") / 400
    k = F.substring_index("entity_code", ".", 1).cast("long") % 9
    return panel(spark, sf).withColumns({"bucket": s.cap_bucket(c("pre_close") * c("volume") * 1e5), "band": s.score_band(x), "state": s.market_state(x), "regime": s.market_regime(x), "advice": s.position_advice(x, k)})


@R.add("f_dates", K + " closes starts preset", sql=f"""
WITH {PANEL} SELECT *, (trade_date + INTERVAL 15 HOUR)::TIMESTAMP AS closes, (trade_date - INTERVAL 100 DAY)::DATE AS starts, (trade_date - INTERVAL 36 MONTH)::DATE AS preset FROM panel""")
def _(spark, sf):
    d = c("trade_date")
    return panel(spark, sf).withColumns({"closes": s.signal_close(d).cast("timestamp_ntz"), "starts": s.source_start(d, 20), "preset": s.preset_start(d, "3y")})


@R.add("f_payload", K + " payload", sql=f"""
WITH {PANEL} SELECT entity_code, trade_date, '{{"nth":' || nth || ',"volume":' || round(volume)::BIGINT || ',"wd":' || is_wd || '}}' AS payload FROM panel""")
def _(spark, sf):
    return panel(spark, sf).withColumn("payload", s.payload(volume=F.round("volume").cast("long"), nth=c("nth"), wd=c("is_wd")))


@R.add("w_basic", K, "mean sum max min", "count", sql=f"""
WITH {PANEL} SELECT *, avg(pct_chg) OVER w AS mean, sum(pct_chg) OVER w AS sum, max(pct_chg) OVER w AS max, min(pct_chg) OVER w AS min, count(pct_chg) OVER w AS count FROM panel WINDOW w AS {over(8)}""")
def _(spark, sf):
    x = c("pct_chg")
    return panel(spark, sf).withColumns({"mean": r.mean(x, 8), "sum": r.sum_(x, 8), "max": r.max_(x, 8), "min": r.min_(x, 8), "count": r.count_(x, 8)})


@R.add("w_moments", K, "std var skew kurt", sql=f"""
WITH {PANEL}, m AS (SELECT *, count(pct_chg) OVER w AS n, avg(pct_chg) OVER w AS mu, list(pct_chg) OVER w AS v FROM panel WINDOW w AS {over(12)}),
d AS (SELECT *, list_sum(list_transform(v, lambda x: pow(x - mu, 2))) AS m2, list_sum(list_transform(v, lambda x: pow(x - mu, 3))) AS m3, list_sum(list_transform(v, lambda x: pow(x - mu, 4))) AS m4 FROM m)
SELECT *, CASE WHEN n > 1 THEN sqrt(m2 / (n - 1)) END AS std, CASE WHEN n > 1 THEN m2 / (n - 1) END AS var,
 CASE WHEN n > 1 AND m2 > 0 THEN (m3 / n) / pow(m2 / (n - 1), 1.5) END AS skew, CASE WHEN n > 1 AND m2 > 0 THEN (m4 / n) / pow(m2 / (n - 1), 2) END AS kurt FROM d""")
def _(spark, sf):
    x = c("pct_chg")
    return panel(spark, sf).withColumns({"std": r.std(x, 12), "var": r.var(x, 12), "skew": r.skew(x, 12), "kurt": r.kurt(x, 12)})


@R.add("w_quantiles", K, "med q25", sql=f"""
WITH {PANEL} SELECT *, quantile_cont(close, 0.5) OVER w AS med, quantile_cont(close, 0.25) OVER w AS q25 FROM panel WINDOW w AS {over(10)}""")
def _(spark, sf):
    return panel(spark, sf).withColumns({"med": r.med(c("close"), 10), "q25": r.quantile(c("close"), 10, 0.25)})


@R.add("w_pairs", K, "corr cov", sql=f"""
WITH {PANEL} SELECT *, CASE WHEN count(*) OVER w > 1 THEN corr(close, volume) OVER w END AS corr, covar_samp(close, volume) OVER w AS cov FROM panel WINDOW w AS {over(10)}""")
def _(spark, sf):
    return panel(spark, sf).withColumns({"corr": r.corr(c("close"), c("volume"), 10), "cov": r.cov(c("close"), c("volume"), 10)})


_LIST = f"WITH {PANEL}, f AS (SELECT *, list_reverse(list({{x}}) OVER w) AS v FROM panel WINDOW w AS {over(9)})"


@R.add("w_mad", K, "mad", sql=f"""{_LIST.format(x="close")}
SELECT *, list_avg(list_transform(v, lambda y: abs(y - list_avg(v)))) AS mad FROM f""")
def _(spark, sf):
    return panel(spark, sf).withColumn("mad", r.mad(c("close"), 9))


@R.add("w_weighted", K, "ema wma", sql=f"""{_LIST.format(x="pct_chg")}
SELECT *, list_sum(list_transform(v, lambda y, i: y * pow(0.8, i - 1))) / nullif(list_sum(list_transform(v, lambda y, i: CASE WHEN y IS NOT NULL THEN pow(0.8, i - 1) END)), 0) AS ema,
 list_sum(list_transform(v, lambda y, i: y * (10 - i))) / nullif(list_sum(list_transform(v, lambda y, i: CASE WHEN y IS NOT NULL THEN 10 - i END)), 0) AS wma FROM f""")
def _(spark, sf):
    return panel(spark, sf).withColumns({"ema": r.ema(c("pct_chg"), 9), "wma": r.wma(c("pct_chg"), 9)})


@R.add("w_rank", K, "ts_rank", sql=f"""{_LIST.format(x="close")}
SELECT *, len(list_filter(v, lambda y: y <= close)) / len(v)::DOUBLE AS ts_rank FROM f""")
def _(spark, sf):
    return panel(spark, sf).withColumn("ts_rank", r.ts_rank(c("close"), 9))


@R.add("w_index", K, "", "hi lo", sql=f"""{_LIST.format(x="volume")}
SELECT *, len(v) - list_position(v, list_max(v)) + 1 AS hi, len(v) - list_position(v, list_min(v)) + 1 AS lo FROM f""")
def _(spark, sf):
    return panel(spark, sf).withColumns({"hi": r.idx_max(c("volume"), 9), "lo": r.idx_min(c("volume"), 9)})


@R.add("w_trend", K, "slope rsquare resi", sql=f"""
WITH {PANEL} SELECT *, CASE WHEN count(*) OVER w > 1 THEN regr_slope(close, nth::DOUBLE) OVER w END AS slope, CASE WHEN count(*) OVER w > 1 THEN regr_r2(close, nth::DOUBLE) OVER w END AS rsquare,
 CASE WHEN count(*) OVER w > 1 THEN close - (regr_intercept(close, nth::DOUBLE) OVER w + regr_slope(close, nth::DOUBLE) OVER w * nth) END AS resi FROM panel WINDOW w AS {over(10)}""")
def _(spark, sf):
    return r.with_row_index(panel(spark, sf)).withColumns({"slope": r.slope(c("close"), 10), "rsquare": r.rsquare(c("close"), 10), "resi": r.resi(c("close"), 10)})


@R.add("w_lags", K, "ref delta ret", "fresh", sql=f"""
WITH {PANEL} SELECT *, lag(close, 4) OVER o AS ref, close - lag(close, 4) OVER o AS delta, close / nullif(lag(close, 4) OVER o, 0) - 1 AS ret,
 (coalesce(pct_chg, 0) > 20 AND coalesce(sum((coalesce(pct_chg, 0) > 20)::INT) OVER (PARTITION BY entity_code ORDER BY trade_date ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 0) = 0)::INT AS fresh
 FROM panel WINDOW o AS {ROWS}""")
def _(spark, sf):
    x = c("close")
    return panel(spark, sf).withColumns({"ref": r.ref(x, 4), "delta": r.delta(x, 4), "ret": r.period_return(x, 4), "fresh": r.first_true(s.gt(c("pct_chg"), 20), 6)})


@R.add("w_nested", K, "signal", sql=f"""
WITH {PANEL}, a AS (SELECT *, avg(close) OVER w3 - avg(close) OVER w8 AS dif FROM panel WINDOW w3 AS {over(3)}, w8 AS {over(8)})
SELECT *, dif - avg(dif) OVER w5 AS signal FROM a WINDOW w5 AS {over(5)}""")
def _(spark, sf):
    levels = r.stage(panel(spark, sf), dif=r.mean(c("close"), 3) - r.mean(c("close"), 8))
    return r.stage(levels, signal=c("dif") - r.mean(c("dif"), 5))
