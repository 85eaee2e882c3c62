"""Queries of factor evaluation and portfolio returns."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import evaluate as e
from ..operators import portfolio as pf
from ..operators import reports as rp
from ..operators import selection as sel
from ..operators.cross_section import DEALT
from .base import Registry, bars, entity_number, once, panel
from .joins import ADJ, factors
from .sources import CAL, cal

R = Registry()
c = F.col
PERIODS = [1, 5, 10]


def prices(spark, sf):
    return bars(spark, sf).select("entity_code", "trade_date", c("close").alias("price"))


def signals(spark, sf):
    """A signal per bar: minus the last move, known on its own date."""
    return panel(spark, sf).where("pct_chg is not null").select("entity_code", c("trade_date").alias("signal_date"), (-c("pct_chg")).alias("factor"))


SQL = f"""{ADJ}, {CAL}, dated AS (SELECT a.*, c.idx FROM adj a JOIN cal c USING (trade_date)),
dense AS (SELECT g.entity_code, c.trade_date, c.idx, d.close FROM (SELECT entity_code, unnest(range(min(idx), max(idx) + 1)) AS idx FROM dated GROUP BY 1) g JOIN cal c USING (idx) LEFT JOIN dated d ON d.entity_code = g.entity_code AND d.idx = g.idx),
fwd AS (SELECT * FROM (SELECT entity_code, trade_date, idx, close, lead(close, 1) OVER o / close - 1 AS fwd_1, lead(close, 5) OVER o / close - 1 AS fwd_5, lead(close, 10) OVER o / close - 1 AS fwd_10 FROM dense WINDOW o AS (PARTITION BY entity_code ORDER BY idx)) WHERE close IS NOT NULL),
clean0 AS (SELECT s.entity_code, n.trade_date, -s.pct_chg AS factor, f.idx, f.fwd_1, f.fwd_5, f.fwd_10 FROM dated s JOIN cal n ON n.idx = s.idx + 1 JOIN fwd f ON f.entity_code = s.entity_code AND f.trade_date = n.trade_date
 WHERE s.pct_chg IS NOT NULL AND fwd_1 IS NOT NULL AND fwd_5 IS NOT NULL AND fwd_10 IS NOT NULL),
clean AS (SELECT *, floor((row_number() OVER (PARTITION BY trade_date ORDER BY factor, entity_code DESC) - 1) * 5 / count(*) OVER (PARTITION BY trade_date)) + 1 AS quantile FROM clean0)"""


def clean(spark, sf):
    return once("clean", lambda: e.clean_factor(signals(spark, sf), prices(spark, sf), cal(spark, sf), PERIODS))


@R.add("a_forward_returns", "entity_code trade_date", "fwd_1 fwd_5 fwd_10", "idx", sql=f"WITH {SQL} SELECT * FROM fwd")
def _(spark, sf):
    return e.forward_returns(prices(spark, sf), cal(spark, sf), PERIODS)


@R.add("a_clean_factor", "entity_code trade_date", "factor fwd_1 fwd_5 fwd_10", "quantile", sql=f"WITH {SQL} SELECT * FROM clean")
def _(spark, sf):
    return clean(spark, sf)


@R.add("a_clean_quantile", "entity_code trade_date", "factor fwd_1", "quantile", sql=f"""
WITH {SQL}, q AS (SELECT trade_date, quantile_cont(factor, [0.2, 0.4, 0.6, 0.8]) AS cuts FROM clean GROUP BY 1)
SELECT entity_code, trade_date, factor, fwd_1, len(list_filter(cuts, lambda e: factor > e)) + 1 AS quantile FROM clean JOIN q USING (trade_date)""")
def _(spark, sf):
    return e.clean_factor(signals(spark, sf), prices(spark, sf), cal(spark, sf), PERIODS, edges="quantile")


_AVG_RANK = "(rank() OVER (PARTITION BY trade_date ORDER BY {x}) + (count(*) OVER (PARTITION BY trade_date, {x}) - 1) / 2.0)"


@R.add("a_rank_ic", "trade_date", "ic", "period n", share=True, sql=f"""
WITH {SQL}, r AS (SELECT trade_date, {_AVG_RANK.format(x="factor")} AS f, {_AVG_RANK.format(x="fwd_1")} AS r1, {_AVG_RANK.format(x="fwd_5")} AS r5, {_AVG_RANK.format(x="fwd_10")} AS r10 FROM clean)
{" UNION ALL ".join(f"SELECT trade_date, {p} AS period, count(*) AS n, CASE WHEN stddev_pop(f) * stddev_pop(r{p}) > 0 THEN corr(f, r{p}) END AS ic FROM r GROUP BY 1" for p in PERIODS)}""")
def _(spark, sf):
    return e.rank_ic(clean(spark, sf), PERIODS)


@R.add("a_quantile_returns", "trade_date", "ret_1 ret_5 ret_10", "quantile n", sql=f"WITH {SQL} SELECT trade_date, quantile, count(*) AS n, avg(fwd_1) AS ret_1, avg(fwd_5) AS ret_5, avg(fwd_10) AS ret_10 FROM clean GROUP BY ALL")
def _(spark, sf):
    return e.quantile_returns(clean(spark, sf), PERIODS)


@R.add("a_turnover", "trade_date", "turnover", "quantile", sql=f"""
WITH {SQL} SELECT a.trade_date, a.quantile, avg(CASE WHEN b.quantile = a.quantile THEN 0.0 ELSE 1.0 END) AS turnover FROM clean a LEFT JOIN clean b ON b.entity_code = a.entity_code AND b.idx = a.idx - 2
WHERE a.idx >= (SELECT min(idx) FROM clean) + 2 GROUP BY ALL""")
def _(spark, sf):
    return e.turnover(clean(spark, sf), 2)


@R.add("a_autocorr", "trade_date", "autocorr", sql=f"""
WITH {SQL}, r AS (SELECT *, {_AVG_RANK.format(x="factor")} AS r FROM clean)
SELECT a.trade_date, CASE WHEN stddev_pop(a.r) * stddev_pop(b.r) > 0 THEN corr(a.r, b.r) END AS autocorr FROM r a JOIN r b ON b.entity_code = a.entity_code AND b.idx = a.idx - 2 GROUP BY 1""")
def _(spark, sf):
    return e.rank_autocorr(clean(spark, sf), 2)


@R.add("a_summary", "metric", "value", "period", share=True, sql=f"""
WITH {SQL}, r AS (SELECT trade_date, {_AVG_RANK.format(x="factor")} AS f, {_AVG_RANK.format(x="fwd_1")} AS r1, {_AVG_RANK.format(x="fwd_5")} AS r5, {_AVG_RANK.format(x="fwd_10")} AS r10 FROM clean),
i AS ({" UNION ALL ".join(f"SELECT trade_date, {p} AS period, CASE WHEN stddev_pop(f) * stddev_pop(r{p}) > 0 THEN corr(f, r{p}) END AS ic FROM r GROUP BY 1" for p in PERIODS)}),
s AS (SELECT period, avg(ic) AS ic_mean, stddev_samp(ic) AS ic_std, avg((ic > 0)::INT::DOUBLE) AS ic_positive, count(ic)::DOUBLE AS ic_days FROM i GROUP BY 1),
q AS (SELECT trade_date, quantile, avg(fwd_1) AS x1, avg(fwd_5) AS x5, avg(fwd_10) AS x10 FROM clean GROUP BY ALL),
tb AS ({" UNION ALL ".join(f"SELECT {p} AS period, avg(x{p}) FILTER (quantile = 5) AS top, avg(x{p}) FILTER (quantile = 1) AS bottom FROM q" for p in PERIODS)}),
tv AS ({" UNION ALL ".join(f"SELECT {p} AS period, avg(t) AS turnover FROM (SELECT a.trade_date, a.quantile, avg(CASE WHEN b.quantile = a.quantile THEN 0.0 ELSE 1.0 END) AS t FROM clean a LEFT JOIN clean b ON b.entity_code = a.entity_code AND b.idx = a.idx - {p} WHERE a.idx >= (SELECT min(idx) FROM clean) + {p} GROUP BY ALL)" for p in PERIODS)}),
rr AS (SELECT *, {_AVG_RANK.format(x="factor")} AS r FROM clean),
ac AS ({" UNION ALL ".join(f"SELECT {p} AS period, avg(x) AS autocorr FROM (SELECT a.trade_date, CASE WHEN stddev_pop(a.r) * stddev_pop(b.r) > 0 THEN corr(a.r, b.r) END AS x FROM rr a JOIN rr b ON b.entity_code = a.entity_code AND b.idx = a.idx - {p} GROUP BY 1)" for p in PERIODS)}),
ct AS (SELECT count(*)::DOUBLE AS rows, count(DISTINCT trade_date)::DOUBLE AS dates, count(DISTINCT entity_code)::DOUBLE AS entities FROM clean),
w AS (SELECT s.*, top, bottom, top - bottom AS spread, turnover, autocorr, rows, dates, entities FROM s JOIN tb USING (period) JOIN tv USING (period) JOIN ac USING (period), ct)
SELECT period, metric, value FROM (UNPIVOT w ON ic_mean, ic_std, ic_positive, ic_days, top, bottom, spread, turnover, autocorr, rows, dates, entities INTO NAME metric VALUE value)""")
def _(spark, sf):
    return e.analysis_summary(clean(spark, sf), PERIODS)


@R.add("g_newey_west", "", "mean t", "n", sql=f"""
WITH {SQL}, d AS (SELECT trade_date, avg(fwd_1) AS x FROM clean GROUP BY 1), e AS (SELECT trade_date, x, x - avg(x) OVER () AS e FROM d),
l AS (SELECT *, lag(e, 1) OVER o AS l1, lag(e, 2) OVER o AS l2, lag(e, 3) OVER o AS l3 FROM e WINDOW o AS (ORDER BY trade_date))
SELECT count(*) AS n, avg(x) AS mean, avg(x) / sqrt((sum(e * e) + 2 * (0.75 * sum(e * l1) + 0.5 * sum(e * l2) + 0.25 * sum(e * l3))) / count(*) / count(*)) AS t FROM l""")
def _(spark, sf):
    return e.newey_west(clean(spark, sf).groupBy("trade_date").agg(F.avg("fwd_1").alias("x")), "x", 3)


# --- portfolios ---


def adjusted_bars(spark, sf):
    from ..operators.joins import adjusted

    return adjusted(bars(spark, sf), factors(spark, sf))


def returns(spark, sf):
    """A hundredth of the open-to-open returns: the prices of order lines jump about, and products of them overflow."""
    return once("returns", lambda: pf.open_returns(adjusted_bars(spark, sf), cal(spark, sf)).withColumn("ret", c("ret") / 100))


RET = f"""{SQL}, firsts AS (SELECT entity_code, min(idx) AS a FROM dated GROUP BY 1), grid AS (SELECT entity_code, c.idx, c.trade_date FROM firsts JOIN cal c ON c.idx >= a),
filled AS (SELECT g.*, last_value(d.adjusted_open IGNORE NULLS) OVER (PARTITION BY g.entity_code ORDER BY g.idx) AS price FROM grid g LEFT JOIN dated d ON d.entity_code = g.entity_code AND d.idx = g.idx),
rawret AS (SELECT * FROM (SELECT *, lead(price) OVER (PARTITION BY entity_code ORDER BY idx) / price - 1 AS ret FROM filled) WHERE ret IS NOT NULL),
ret AS (SELECT * REPLACE (ret / 100 AS ret) FROM rawret)"""


@R.add("p_open_returns", "entity_code trade_date", "ret", "idx", sql=f"WITH {RET} SELECT * FROM rawret")
def _(spark, sf):
    return pf.open_returns(adjusted_bars(spark, sf), cal(spark, sf))


@R.add("p_trade_flags", "entity_code trade_date", "", "buy_allowed sell_allowed", sql=f"""
WITH {ADJ} SELECT *, (is_susp = 0 AND NOT coalesce(open >= high_limited - 1e-8, FALSE))::INT AS buy_allowed, (is_susp = 0 AND NOT coalesce(open <= low_limited + 1e-8, FALSE))::INT AS sell_allowed FROM adj""")
def _(spark, sf):
    return pf.trade_flags(panel(spark, sf))


def scores(spark, sf):
    """Scores on the session after the signal, for bars that may be bought then."""
    from ..operators.joins import next_session

    def make():
        moved = next_session(signals(spark, sf), cal(spark, sf)).select("entity_code", "trade_date", c("factor").alias("score"))
        ok = pf.trade_flags(panel(spark, sf)).where("buy_allowed = 1").select("entity_code", "trade_date")
        return moved.join(ok, ["entity_code", "trade_date"])

    return once("scores", make)


SCORES = f"""{RET}, scores AS (SELECT s.entity_code, n.trade_date, -s.pct_chg AS score FROM dated s JOIN cal n ON n.idx = s.idx + 1 JOIN adj p ON p.entity_code = s.entity_code AND p.trade_date = n.trade_date
 WHERE s.pct_chg IS NOT NULL AND p.is_susp = 0 AND NOT coalesce(p.open >= p.high_limited - 1e-8, FALSE))"""
TOP = f"""{SCORES}, days AS (SELECT trade_date FROM (SELECT trade_date, row_number() OVER (ORDER BY trade_date) - 1 AS i FROM (SELECT DISTINCT trade_date FROM scores)) WHERE i % 4 = 0),
rk AS (SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY score DESC, entity_code) AS r, count(*) OVER (PARTITION BY trade_date) AS n FROM scores WHERE trade_date IN (SELECT trade_date FROM days)),
tg AS (SELECT entity_code, trade_date, score, 0.2::DOUBLE AS weight FROM rk WHERE n >= 5 AND r <= 5)"""


@R.add("p_quintiles", "entity_code trade_date", "weight", "bucket", sql=f"""
WITH {SCORES}, r AS (SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY score, entity_code) - 1 AS pos, count(*) OVER (PARTITION BY trade_date) AS n FROM scores),
g AS (SELECT *, least(floor(pos / greatest(1, floor(n / 5))), 4) + 1 AS bucket FROM r WHERE n >= 25) SELECT *, 1.0 / count(*) OVER (PARTITION BY trade_date, bucket) AS weight FROM g""")
def _(spark, sf):
    return pf.quintile_targets(scores(spark, sf))


def top(spark, sf):
    return pf.topn_targets(scores(spark, sf), 5, 4)


@R.add("p_topn", "entity_code trade_date", "score weight", sql=f"WITH {TOP} SELECT * FROM tg")
def _(spark, sf):
    return top(spark, sf)


@R.add("p_target_ic", "trade_date", "ic", "n", share=True, sql=f"""
WITH {SCORES}, m AS (SELECT s.*, r.ret FROM scores s JOIN ret r USING (entity_code, trade_date)), k AS (SELECT trade_date, {_AVG_RANK.format(x="score")} AS a, {_AVG_RANK.format(x="ret")} AS b FROM m)
SELECT trade_date, count(*) AS n, CASE WHEN stddev_pop(a) * stddev_pop(b) > 0 THEN corr(a, b) END AS ic FROM k GROUP BY 1""")
def _(spark, sf):
    return pf.target_ic(scores(spark, sf), returns(spark, sf))


PORT = f"""{TOP}, st AS (SELECT trade_date, idx, coalesce(lead(idx) OVER (ORDER BY idx) - 1, (SELECT max(idx) - 1 FROM cal)) AS until FROM (SELECT DISTINCT trade_date FROM tg) JOIN cal USING (trade_date)),
hold AS (SELECT t.entity_code, t.weight, s.idx AS start, c.idx, c.trade_date, coalesce(r.ret, 0) AS ret FROM tg t JOIN st s USING (trade_date) JOIN cal c ON c.idx BETWEEN s.idx AND s.until LEFT JOIN ret r ON r.entity_code = t.entity_code AND r.idx = c.idx),
val AS (SELECT *, weight * exp(coalesce(sum(ln(1 + ret)) OVER (PARTITION BY start, entity_code ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS value FROM hold),
daily AS (SELECT trade_date, sum(value * (1 + ret)) / sum(value) - 1 AS ret, count(*) AS names FROM val GROUP BY 1),
nv AS (SELECT *, exp(sum(ln(1 + ret)) OVER (ORDER BY trade_date)) AS nav FROM daily)"""


def daily(spark, sf):
    return once("daily", lambda: pf.portfolio_returns(top(spark, sf), returns(spark, sf), cal(spark, sf)))


@R.add("p_portfolio_returns", "trade_date", "ret", "names", share=True, sql=f"WITH {PORT} SELECT * FROM daily")
def _(spark, sf):
    return daily(spark, sf)


@R.add("p_turnover_cost", "trade_date", "turnover cost", share=True, sql=f"""
WITH {PORT}, l AS (SELECT *, row_number() OVER (PARTITION BY start, entity_code ORDER BY idx DESC) AS r FROM val), old AS (SELECT entity_code, idx + 1 AS idx, value * (1 + ret) / sum(value * (1 + ret)) OVER (PARTITION BY start) AS old FROM l WHERE r = 1),
nw AS (SELECT t.entity_code, c.idx, t.weight AS new FROM tg t JOIN cal c USING (trade_date)),
m AS (SELECT idx, coalesce(new, 0) AS new, coalesce(old, 0) AS old FROM nw FULL JOIN (SELECT * FROM old WHERE idx IN (SELECT idx FROM nw)) o USING (entity_code, idx)),
s AS (SELECT idx, sum(greatest(new - old, 0)) AS b, sum(greatest(old - new, 0)) AS z FROM m GROUP BY 1) SELECT c.trade_date, (b + z) / 2 AS turnover, b * 0.0003 + z * 0.0013 AS cost FROM s JOIN cal c USING (idx)""")
def _(spark, sf):
    return pf.turnover_cost(top(spark, sf), returns(spark, sf), cal(spark, sf))


BENCH = "b AS (SELECT trade_date, lead(open) OVER (ORDER BY trade_date) / open - 1 AS bench FROM bars WHERE entity_code = '000001.SZ')"


@R.add("p_benchmark", "trade_date", "bench", sql=f"WITH {ADJ}, {BENCH} SELECT * FROM b WHERE bench IS NOT NULL")
def _(spark, sf):
    return pf.benchmark_returns(bars(spark, sf), "000001.SZ")


@R.add("p_nav", "trade_date", "ret nav bench_nav excess", share=True, sql=f"""
WITH {PORT}, {BENCH} SELECT n.*, exp(sum(ln(1 + coalesce(bench / 100, 0))) OVER (ORDER BY trade_date)) AS bench_nav, nav / exp(sum(ln(1 + coalesce(bench / 100, 0))) OVER (ORDER BY trade_date)) - 1 AS excess FROM nv n LEFT JOIN b USING (trade_date)""")
def _(spark, sf):
    return pf.nav(daily(spark, sf), benchmark=pf.benchmark_returns(bars(spark, sf), "000001.SZ").withColumn("bench", c("bench") / 100))


SIDES = f"""{SCORES}, {BENCH}, qr AS (SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY score, entity_code) - 1 AS pos, count(*) OVER (PARTITION BY trade_date) AS n FROM scores),
qg AS (SELECT *, least(floor(pos / greatest(1, floor(n / 5))), 4) + 1 AS bucket FROM qr WHERE n >= 25), tq AS (SELECT *, 1.0::DOUBLE / count(*) OVER (PARTITION BY trade_date, bucket) AS weight FROM qg),
qt AS (SELECT trade_date, idx, coalesce(lead(idx) OVER (ORDER BY idx) - 1, (SELECT max(idx) - 1 FROM cal)) AS until FROM (SELECT DISTINCT trade_date FROM tq) JOIN cal USING (trade_date)),
qh AS (SELECT t.bucket, t.entity_code, t.weight, s.idx AS start, c.idx, c.trade_date, coalesce(r.ret, 0) AS ret FROM tq t JOIN qt s USING (trade_date) JOIN cal c ON c.idx BETWEEN s.idx AND s.until LEFT JOIN ret r ON r.entity_code = t.entity_code AND r.idx = c.idx),
qv AS (SELECT *, weight * exp(coalesce(sum(ln(1 + ret)) OVER (PARTITION BY bucket, start, entity_code ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS value FROM qh),
qd AS (SELECT bucket, trade_date, sum(value * (1 + ret)) / sum(value) - 1 AS ret FROM qv GROUP BY ALL),
ql AS (SELECT *, row_number() OVER (PARTITION BY bucket, start, entity_code ORDER BY idx DESC) AS r FROM qv), qo AS (SELECT bucket, entity_code, idx + 1 AS idx, value * (1 + ret) / sum(value * (1 + ret)) OVER (PARTITION BY bucket, start) AS old FROM ql WHERE r = 1),
qn AS (SELECT t.bucket, t.entity_code, c.idx, t.weight AS new FROM tq t JOIN cal c USING (trade_date)),
qm AS (SELECT bucket, idx, coalesce(new, 0) AS new, coalesce(old, 0) AS old FROM qn FULL JOIN (SELECT * FROM qo WHERE idx IN (SELECT idx FROM qn)) o USING (bucket, entity_code, idx)),
qc AS (SELECT bucket, c.trade_date, (sum(greatest(new - old, 0)) + sum(greatest(old - new, 0))) / 2 AS turnover, sum(greatest(new - old, 0)) * 0.0003 + sum(greatest(old - new, 0)) * 0.0013 AS cost FROM qm JOIN cal c USING (idx) GROUP BY ALL),
sd AS (SELECT bucket, trade_date, ret - coalesce(cost, 0) AS ret, coalesce(turnover, 0) AS turnover, coalesce(cost, 0) AS cost FROM qd LEFT JOIN qc USING (bucket, trade_date)),
ls AS (SELECT trade_date, l.ret AS low_return, h.ret AS high_return, bench / 100 AS bench, h.ret - l.ret AS long_short, h.ret - bench / 100 AS excess, (l.turnover + h.turnover) / 2 AS turnover, (l.cost + h.cost) / 2 AS cost FROM (SELECT * FROM sd WHERE bucket = 1) l JOIN (SELECT * FROM sd WHERE bucket = 5) h USING (trade_date) JOIN b USING (trade_date) WHERE bench IS NOT NULL),
lv AS (SELECT *, exp(sum(ln(1 + low_return)) OVER o) AS low_nav, exp(sum(ln(1 + high_return)) OVER o) AS high_nav, exp(sum(ln(1 + long_short)) OVER o) AS long_short_nav, exp(sum(ln(1 + bench)) OVER o) AS bench_nav FROM ls WINDOW o AS (ORDER BY trade_date)),
mi AS (SELECT s.*, r.ret FROM scores s JOIN ret r USING (entity_code, trade_date)), ki AS (SELECT trade_date, {_AVG_RANK.format(x="score")} AS a, {_AVG_RANK.format(x="ret")} AS b FROM mi), ti AS (SELECT trade_date, count(*) AS n, CASE WHEN stddev_pop(a) * stddev_pop(b) > 0 THEN corr(a, b) END AS ic FROM ki GROUP BY 1)"""


def sides(spark, sf):
    """Lowest and highest fifth of the scores, held from one date with scores to the next."""
    targets = once("quintiles", lambda: pf.quintile_targets(scores(spark, sf)))
    own = once("sides", lambda: pf.portfolio_returns(targets, returns(spark, sf), cal(spark, sf), ("bucket",)).join(pf.turnover_cost(targets, returns(spark, sf), cal(spark, sf), ("bucket",)), ["bucket", "trade_date"], "left"))
    bench = pf.benchmark_returns(bars(spark, sf), "000001.SZ").withColumn("bench", c("bench") / 100)
    return rp.long_short(own.where("bucket = 1"), own.where("bucket = 5"), bench)


@R.add("p_long_short", "trade_date", "low_return high_return long_short excess turnover cost low_nav high_nav long_short_nav bench_nav", share=True, sql=f"WITH {SIDES} SELECT * FROM lv")
def _(spark, sf):
    return sides(spark, sf)


@R.add("p_long_short_summary", "", "annual annual_excess annual_long_short turnover ic_mean ic_ir max_drawdown", "days whole_days", share=True, sql=f"""
WITH {SIDES}, lf AS (SELECT *, high_nav / max(high_nav) OVER (ORDER BY trade_date) - 1 AS fall FROM lv LEFT JOIN ti USING (trade_date)), g AS (SELECT product(1 + high_return) AS a, product(1 + excess) AS e, product(1 + long_short) AS l, count(*) AS days, avg(turnover) AS turnover, avg(ic) AS ic_mean, avg(ic) / nullif(stddev_samp(ic), 0) AS ic_ir, min(fall) AS max_drawdown, count(*) FILTER (n >= 25) AS whole_days FROM lf)
SELECT *, CASE WHEN a > 0 THEN pow(a, 252.0 / days) - 1 ELSE -1 END AS annual, CASE WHEN e > 0 THEN pow(e, 252.0 / days) - 1 ELSE -1 END AS annual_excess, CASE WHEN l > 0 THEN pow(l, 252.0 / days) - 1 ELSE -1 END AS annual_long_short FROM g""")
def _(spark, sf):
    return rp.long_short_summary(sides(spark, sf), pf.target_ic(scores(spark, sf), returns(spark, sf)))


PERF = """SELECT {k} count(*) AS days, max_by(nav, trade_date) - 1 AS total, CASE WHEN max_by(nav, trade_date) > 0 THEN pow(max_by(nav, trade_date), 252.0 / count(*)) - 1 ELSE -1 END AS annual,
 min(nav / greatest(peak, 1) - 1) AS max_drawdown, sqrt(252) * avg(ret) / nullif(stddev_samp(ret), 0) AS sharpe FROM (SELECT *, max(nav) OVER ({p} ORDER BY trade_date) AS peak FROM {f}) {g}"""


@R.add("p_performance", "", "total annual max_drawdown sharpe", "days", share=True, sql=f"WITH {PORT} {PERF.format(k='', p='', f='nv', g='')}")
def _(spark, sf):
    return pf.performance(daily(spark, sf))


@R.add("p_monthly", "month", "ret", share=True, sql=f"""
WITH {PORT}, m AS (SELECT date_trunc('month', trade_date)::DATE AS month, max_by(nav, trade_date) AS nav FROM nv GROUP BY 1) SELECT * FROM (SELECT month, nav / lag(nav) OVER (ORDER BY month) - 1 AS ret FROM m) WHERE ret IS NOT NULL""")
def _(spark, sf):
    return pf.monthly_returns(pf.nav(daily(spark, sf)))


@R.add("k_nav_stats", "", "total annual drawdown ratio", "days", share=True, sql=f"""
WITH {PORT}, f AS (SELECT *, (max(nav) OVER (ORDER BY trade_date) - nav) / max(nav) OVER (ORDER BY trade_date) AS fall FROM nv), s AS (SELECT count(*) AS days, max_by(nav, trade_date) - 1 AS total, max(fall) AS drawdown FROM f)
SELECT *, CASE WHEN total > -1 THEN pow(1 + total, 252.0 / days) - 1 ELSE -1 END AS annual, CASE WHEN drawdown > 0 THEN total / drawdown ELSE 0 END AS ratio FROM s""")
def _(spark, sf):
    return sel.nav_stats(pf.nav(daily(spark, sf)))


@R.add("p_holdings", "trade_date holdings", sql=f"WITH {TOP} SELECT trade_date, list_sort(list(entity_code)) AS holdings FROM tg GROUP BY 1")
def _(spark, sf):
    return pf.holdings(top(spark, sf))


MANY = f"""{SCORES}, r0 AS (SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY score, entity_code) - 1 AS pos, count(*) OVER (PARTITION BY trade_date) AS n FROM scores),
g AS (SELECT *, least(floor(pos / greatest(1, floor(n / 5))), 4) + 1 AS bucket FROM r0 WHERE n >= 25), tg AS (SELECT *, 1.0 / count(*) OVER (PARTITION BY trade_date, bucket) AS weight FROM g),
st AS (SELECT bucket, trade_date, idx, coalesce(lead(idx) OVER (PARTITION BY bucket ORDER BY idx) - 1, (SELECT max(idx) - 1 FROM cal)) AS until FROM (SELECT DISTINCT bucket, trade_date FROM tg) JOIN cal USING (trade_date)),
hold AS (SELECT t.bucket, t.entity_code, t.weight, s.idx AS start, c.idx, c.trade_date, coalesce(r.ret, 0) AS ret FROM tg t JOIN st s USING (bucket, trade_date) JOIN cal c ON c.idx BETWEEN s.idx AND s.until LEFT JOIN ret r ON r.entity_code = t.entity_code AND r.idx = c.idx),
val AS (SELECT *, weight * exp(coalesce(sum(ln(1 + ret)) OVER (PARTITION BY bucket, start, entity_code ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS value FROM hold),
daily AS (SELECT bucket, trade_date, sum(value * (1 + ret)) / sum(value) - 1 AS ret FROM val GROUP BY ALL)"""


@R.add("p_many", "", "total annual max_drawdown sharpe", "bucket days", share=True, sql=f"""
WITH {MANY}, nv AS (SELECT *, exp(sum(ln(1 + ret)) OVER (PARTITION BY bucket ORDER BY trade_date)) AS nav FROM daily)
{PERF.format(k="bucket,", p="PARTITION BY bucket", f="nv", g="GROUP BY bucket")}""")
def _(spark, sf):
    """All five quintile portfolios in one run, the bucket being part of every key."""
    t = pf.quintile_targets(scores(spark, sf))
    return pf.performance(pf.portfolio_returns(t, returns(spark, sf), cal(spark, sf), ("bucket",)), ("bucket",))


# --- several engines ---


def predictions(spark, sf):
    """Three engines: two by price, one by volume; each leaves out some names."""
    p = panel(spark, sf).where("pct_chg is not null").select("trade_date", "entity_code", "pct_chg", "volume", "turnover_rate").repartition(DEALT, "trade_date")
    k = entity_number()
    x = Window.partitionBy("trade_date")
    p = p.select("*", *[(2 * F.percent_rank().over(x.orderBy(f)) - 1).alias(f"s_{f}") for f in ("pct_chg", "volume", "turnover_rate")])
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("engine"), c(f"s_{f}").alias("score"), (k % m != 0).alias("on")) for n, f, m in (("a", "pct_chg", 7), ("b", "volume", 5), ("c", "turnover_rate", 11))]))
    return p.select("trade_date", "entity_code", rows.alias("e")).select("trade_date", "entity_code", "e.*").where("on").drop("on")


def side_scores(p):
    """The scores of predictions as columns a, b and c of the panel's rows, null where an engine leaves a name out."""
    k, has = entity_number(), c("pct_chg").isNotNull()
    ready = p.withColumn("__has", has)
    x = Window.partitionBy("trade_date", "__has")
    score = lambda f, m: F.when(has & (k % m != 0), 2 * F.percent_rank().over(x.orderBy(f)) - 1)
    return ready.withColumns({n: score(f, m) for n, f, m in (("a", "pct_chg", 7), ("b", "volume", 5), ("c", "turnover_rate", 11))}).drop("__has")


def engines(spark):
    return spark.createDataFrame([("a", 1, 0.5, -0.2, 20), ("b", 2, 0.3, -0.4, 30), ("c", 3, 0.2, 0.0, 25)], "engine string, priority int, weight double, threshold double, top_n int")


PRED = f"""{ADJ}, z AS (SELECT *, 2 * percent_rank() OVER (PARTITION BY trade_date ORDER BY pct_chg) - 1 AS sa, 2 * percent_rank() OVER (PARTITION BY trade_date ORDER BY volume) - 1 AS sb, 2 * percent_rank() OVER (PARTITION BY trade_date ORDER BY turnover_rate) - 1 AS sc FROM panel WHERE pct_chg IS NOT NULL),
pred AS (SELECT trade_date, entity_code, 'a' AS engine, sa AS score FROM z WHERE k % 7 <> 0 UNION ALL SELECT trade_date, entity_code, 'b', sb FROM z WHERE k % 5 <> 0 UNION ALL SELECT trade_date, entity_code, 'c', sc FROM z WHERE k % 11 <> 0),
eng AS (SELECT * FROM (VALUES ('a', 1, 0.5, -0.2, 20), ('b', 2, 0.3, -0.4, 30), ('c', 3, 0.2, 0.0, 25)) t(engine, priority, weight, threshold, top_n)),
comp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY engine, trade_date ORDER BY score DESC, entity_code) AS position FROM pred JOIN eng USING (engine) WHERE score >= threshold) WHERE position <= top_n)"""


def composed(spark, sf):
    return pf.compose(predictions(spark, sf), engines(spark))


@R.add("p_compose", "trade_date entity_code engine", "score", "position", sql=f"WITH {PRED} SELECT * FROM comp")
def _(spark, sf):
    return composed(spark, sf)


@R.add("p_gated", "trade_date entity_code", "score", sql=f"WITH {PRED} SELECT * FROM comp x WHERE engine = 'a' AND EXISTS (SELECT 1 FROM comp y WHERE y.engine = 'b' AND y.trade_date = x.trade_date AND y.entity_code = x.entity_code) AND EXISTS (SELECT 1 FROM comp y WHERE y.engine = 'c' AND y.trade_date = x.trade_date AND y.entity_code = x.entity_code)")
def _(spark, sf):
    return pf.gated(composed(spark, sf), ["b", "c"], "a")


@R.add("p_merge_priority", "trade_date entity_code", "score", "place", sql=f"""
WITH {PRED}, b AS (SELECT trade_date, entity_code, min(priority * 1000 + position) AS o FROM comp GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY o, entity_code) AS place, count(*) OVER (PARTITION BY trade_date) AS n FROM b)
SELECT *, CASE WHEN n > 1 THEN 1 - 2.0 * (place - 1) / (n - 1) ELSE 1 END AS score FROM r""")
def _(spark, sf):
    return pf.merge_priority(composed(spark, sf))


@R.add("p_merge_weighted", "trade_date entity_code", "score", sql=f"WITH {PRED} SELECT trade_date, entity_code, greatest(-1, least(1, sum(weight::DOUBLE * score) / sum(weight::DOUBLE))) AS score FROM comp GROUP BY ALL HAVING count(DISTINCT engine) = 3")
def _(spark, sf):
    return pf.merge_weighted(composed(spark, sf), 3)


@R.add("p_merge_union", "trade_date entity_code", "score", sql=f"WITH {PRED} SELECT trade_date, entity_code, sum(weight::DOUBLE * score) / sum(weight::DOUBLE) AS score FROM comp GROUP BY ALL")
def _(spark, sf):
    return pf.merge_union(composed(spark, sf))


@R.add("p_gate_audit", "engine", "mean", "dates least most", sql=f"WITH {PRED}, n AS (SELECT engine, trade_date, count(*) AS n FROM comp GROUP BY ALL) SELECT engine, count(*) AS dates, avg(n) AS mean, min(n) AS least, max(n) AS most FROM n GROUP BY 1")
def _(spark, sf):
    return pf.gate_audit(composed(spark, sf))


def yearly(spark, sf):
    """A window per year, from its first session to its last."""
    y = F.year("trade_date")
    return cal(spark, sf).groupBy(y.alias("window")).agg(F.min("trade_date").alias("start_date"), F.max("trade_date").alias("end_date"))


def excess(spark, sf):
    bench = pf.benchmark_returns(bars(spark, sf), "000001.SZ").select("trade_date", (c("bench") / 1000).alias("bench"))
    return daily(spark, sf).join(bench, "trade_date", "left").withColumn("excess", c("ret") - F.coalesce("bench", F.lit(0.0)))


REPORT = f"""{PORT}, {BENCH}, yr AS (SELECT year(trade_date) AS win, min(trade_date) AS a, max(trade_date) AS z FROM cal GROUP BY 1),
dx AS (SELECT year(trade_date) AS win, trade_date, ret, ret - coalesce(bench / 1000, 0) AS excess FROM daily LEFT JOIN b USING (trade_date)),
n1 AS (SELECT *, exp(sum(ln(1 + ret)) OVER (PARTITION BY win ORDER BY trade_date)) AS nav FROM dx), n2 AS (SELECT win, trade_date, excess AS ret, exp(sum(ln(1 + excess)) OVER (PARTITION BY win ORDER BY trade_date)) AS nav FROM dx),
r1 AS ({PERF.format(k="win,", p="PARTITION BY win", f="n1", g="GROUP BY win")}), r2 AS ({PERF.format(k="win,", p="PARTITION BY win", f="n2", g="GROUP BY win")}),
cm AS (SELECT win, (min(trade_date) <= any_value(a) AND max(trade_date) >= any_value(z))::INT AS complete FROM dx JOIN yr USING (win) GROUP BY 1),
rep AS (SELECT r1.*, win AS year, r2.annual AS excess_annual, complete FROM r1 JOIN r2 USING (win) JOIN cm USING (win))"""


@R.add("p_window_report", "", "total annual max_drawdown sharpe excess_annual", "year days complete", share=True, sql=f"WITH {REPORT} SELECT * FROM rep")
def _(spark, sf):
    return pf.window_report(excess(spark, sf), yearly(spark, sf)).withColumnRenamed("window", "year")


@R.add("p_window_stability", "failed status", "mean_excess positive_window_ratio excess_std worst_window", "complete_window_count", share=True, sql=f"""
WITH {REPORT}, s AS (SELECT count(*) AS complete_window_count, avg(excess_annual) AS mean_excess, avg((excess_annual > 0)::INT) AS positive_window_ratio, stddev_pop(excess_annual) AS excess_std, min(excess_annual) AS worst_window FROM rep WHERE complete = 1),
f AS (SELECT *, list_filter([CASE WHEN complete_window_count < 3 THEN 'complete_window_count' END, CASE WHEN mean_excess <= 0 THEN 'mean_excess' END, CASE WHEN positive_window_ratio < 2 / 3.0::DOUBLE THEN 'positive_window_ratio' END,
 CASE WHEN excess_std > 0.1 THEN 'excess_std' END, CASE WHEN worst_window < -0.05 THEN 'worst_window' END], lambda x: x IS NOT NULL) AS failed FROM s) SELECT *, CASE WHEN mean_excess IS NULL THEN 'insufficient' WHEN len(failed) = 0 THEN 'stable' ELSE 'unstable' END AS status FROM f""")
def _(spark, sf):
    return pf.window_stability(pf.window_report(excess(spark, sf), yearly(spark, sf)))


@R.add("p_gate_attribution", "regime", "bench_annual mean_excess style_delta industry_delta full_delta interaction", "year all_negative weakest", share=True, sql=f"""
WITH {MANY}, {BENCH}, dx AS (SELECT bucket, year(trade_date) AS win, trade_date, ret, ret - coalesce(bench / 1000, 0) AS excess FROM daily LEFT JOIN b USING (trade_date) WHERE bucket <= 4),
n1 AS (SELECT *, exp(sum(ln(1 + ret)) OVER (PARTITION BY bucket, win ORDER BY trade_date)) AS nav FROM dx), n2 AS (SELECT bucket, win, trade_date, excess AS ret, exp(sum(ln(1 + excess)) OVER (PARTITION BY bucket, win ORDER BY trade_date)) AS nav FROM dx),
r1 AS ({PERF.format(k="bucket, win,", p="PARTITION BY bucket, win", f="n1", g="GROUP BY bucket, win")}), r2 AS ({PERF.format(k="bucket, win,", p="PARTITION BY bucket, win", f="n2", g="GROUP BY bucket, win")}),
pv AS (SELECT win, max(r2.annual) FILTER (bucket = 1) AS e1, max(r2.annual) FILTER (bucket = 2) AS e2, max(r2.annual) FILTER (bucket = 3) AS e3, max(r2.annual) FILTER (bucket = 4) AS e4, avg(r1.annual - r2.annual) AS bench_annual FROM r1 JOIN r2 USING (bucket, win) GROUP BY 1 HAVING count(*) = 4),
w AS (SELECT *, (e1 + e2 + e3 + e4) / 4 AS mean_excess FROM pv)
SELECT win AS year, bench_annual, mean_excess, (greatest(e1, e2, e3, e4) < 0)::INT AS all_negative, e2 - e1 AS style_delta, e3 - e1 AS industry_delta, e4 - e3 AS full_delta, e4 - e3 - e2 + e1 AS interaction,
 CASE WHEN bench_annual >= 0.2 THEN 'strong_bull' WHEN bench_annual >= 0.05 THEN 'bull' WHEN bench_annual <= -0.1 THEN 'bear' ELSE 'sideways' END AS regime, (row_number() OVER (ORDER BY mean_excess, win) = 1)::INT AS weakest FROM w""")
def _(spark, sf):
    """The first four quintile portfolios stand for the four profiles; a window per year."""
    t = pf.quintile_targets(scores(spark, sf)).where("bucket <= 4").withColumn("profile", F.element_at(F.array(*map(F.lit, pf.PROFILES)), c("bucket")))
    days = pf.portfolio_returns(t, returns(spark, sf), cal(spark, sf), ("profile",))
    bench = pf.benchmark_returns(bars(spark, sf), "000001.SZ").select("trade_date", (c("bench") / 1000).alias("bench"))
    each = days.join(bench, "trade_date", "left").select("profile", F.year("trade_date").alias("window"), "trade_date", "ret", (c("ret") - F.coalesce("bench", F.lit(0.0))).alias("excess"))
    own, less = (pf.performance(each.select("profile", "window", "trade_date", c(v).alias("ret")), ("profile", "window")) for v in ("ret", "excess"))
    both = own.select("profile", "window", "annual").join(less.select("profile", "window", c("annual").alias("excess_annual")), ["profile", "window"])
    return pf.gate_attribution(both).withColumnRenamed("window", "year")


@R.add("p_aligned_windows", "", "", "engines variants aligned", sql=f"""
WITH {PRED}, w AS (SELECT engine, list_sort(list(DISTINCT year(trade_date))) AS w FROM comp GROUP BY 1) SELECT count(*) AS engines, count(DISTINCT w) AS variants, (count(DISTINCT w) = 1)::INT AS aligned FROM w""")
def _(spark, sf):
    w = composed(spark, sf).select("engine", F.trunc("trade_date", "year").alias("start_date")).distinct().withColumn("end_date", F.add_months("start_date", 12))
    return pf.aligned_windows(w)


@R.add("p_order_snapshot", "entity_code", "close", "target held buy_allowed sell_allowed", sql=f"""
WITH {SCORES}, d AS (SELECT max(trade_date) AS d FROM scores WHERE trade_date < DATE '2000-06-01'), tt AS (SELECT entity_code, 1 AS target FROM scores, d WHERE trade_date = d ORDER BY score DESC, entity_code LIMIT 10),
h AS (SELECT DISTINCT entity_code, 1 AS held FROM adj WHERE k % 20 = 5),
f AS (SELECT entity_code, close, (is_susp = 0 AND NOT coalesce(open >= high_limited - 1e-8, FALSE))::INT AS buy_allowed, (is_susp = 0 AND NOT coalesce(open <= low_limited + 1e-8, FALSE))::INT AS sell_allowed FROM adj, d WHERE trade_date = d)
SELECT entity_code, coalesce(target, 0) AS target, coalesce(held, 0) AS held, close, buy_allowed, sell_allowed FROM tt FULL JOIN h USING (entity_code) LEFT JOIN f USING (entity_code)""")
def _(spark, sf):
    held = bars(spark, sf).where(entity_number() % 20 == 5).select("entity_code").distinct()
    return pf.order_snapshot(scores(spark, sf), panel(spark, sf), held, "2000-06-01", 10)
