"""Queries of joins, point-in-time visibility and universes."""

from pyspark.sql import functions as F

from ..operators import joins as j
from . import base
from .base import BARS, CODE, PANEL, Registry, bars, entity_number, panel, table
from .sources import CAL, VALUES, basics, cal, values

R = Registry()
K = "entity_code trade_date"
c = F.col


@R.add("j_left_any", K, "close turn", sql=f"""
WITH {PANEL}, x AS (SELECT entity_code, trade_date, max(volume) AS turn FROM (SELECT * FROM panel UNION ALL SELECT * FROM panel) WHERE k % 3 = 1 GROUP BY ALL) SELECT * FROM bars LEFT JOIN x USING (entity_code, trade_date)""")
def _(spark, sf):
    p = panel(spark, sf).where(entity_number() % 3 == 1).select("entity_code", "trade_date", c("volume").alias("turn"))
    return j.left_any(bars(spark, sf), p.unionByName(p), ["entity_code", "trade_date"])


@R.add("j_universe", K, "close", sql=f"""
WITH {BARS}, b AS (SELECT {CODE.format(k="s_suppkey")} AS entity_code FROM supplier WHERE s_nationkey % 2 = 1) SELECT * FROM bars WHERE entity_code IN (SELECT entity_code FROM b)""")
def _(spark, sf):
    return j.semi_universe(bars(spark, sf), basics(spark, sf))


@R.add("j_asof_events", "event_id", "value last_purchase", sql="""
WITH p AS (SELECT user_id, ts, max(value) AS last_purchase FROM events WHERE event_type = 'purchase' GROUP BY ALL)
SELECT e.event_id, e.value, p.last_purchase FROM (SELECT * FROM events WHERE event_type = 'click') e ASOF LEFT JOIN p ON e.user_id = p.user_id AND e.ts >= p.ts""")
def _(spark, sf):
    e = table(spark, sf, "events")
    bought = e.where("event_type = 'purchase'").select("user_id", "ts", c("value").alias("last_purchase"))
    return j.asof_join(e.where("event_type = 'click'").select("event_id", "user_id", "ts", "value"), bought, "user_id", "ts", "last_purchase")


def factors(spark, sf):
    """A split now and then."""
    return panel(spark, sf).where((entity_number() + c("nth")) % 40 == 0).select("entity_code", "trade_date", (1 + c("nth") / 100).alias("factor"))


ADJ = f"""{PANEL}, fac AS (SELECT entity_code, trade_date, 1 + nth / 100.0::DOUBLE AS factor FROM panel WHERE (k + nth) % 40 = 0),
adj AS (SELECT p.*, coalesce(f.factor, 1.0) AS factor, p.open * coalesce(f.factor, 1.0) AS adjusted_open, p.close * coalesce(f.factor, 1.0) AS adjusted_close FROM panel p ASOF LEFT JOIN fac f ON p.entity_code = f.entity_code AND p.trade_date >= f.trade_date)"""


@R.add("j_adjusted", K, "factor adjusted_open adjusted_close", sql=f"WITH {ADJ} SELECT * FROM adj")
def _(spark, sf):
    return j.adjusted(bars(spark, sf), factors(spark, sf))


def shares(spark, sf):
    p = panel(spark, sf).where(c("nth") % 30 == 1)
    return p.select("entity_code", F.date_add("trade_date", 10).alias("ann_date"), F.date_add("trade_date", (entity_number() % 20).cast("int")).alias("change_date"), (entity_number() * 10 + c("nth")).cast("double").alias("total_share"))


CAP = f"""{PANEL}, sh AS (SELECT entity_code, greatest(trade_date + 10, trade_date + (k % 20)::INT) AS d, max((k * 10 + nth)::DOUBLE) AS total_share FROM panel WHERE nth % 30 = 1 AND k * 10 + nth > 0 GROUP BY ALL),
cap AS (SELECT p.*, s.total_share, p.close * s.total_share * 10000 AS cap FROM panel p ASOF LEFT JOIN sh s ON p.entity_code = s.entity_code AND p.trade_date >= s.d)"""


@R.add("j_market_cap", K, "cap log_cap", sql=f"WITH {CAP} SELECT *, CASE WHEN cap > 0 THEN ln(cap) END AS log_cap FROM cap")
def _(spark, sf):
    return j.market_cap(bars(spark, sf), shares(spark, sf))


def members(spark, sf):
    """An interval per supplier by its number, open for a third of them, two for some."""
    s = table(spark, sf, "supplier")
    k = c("s_suppkey").cast("int")
    start = F.date_add(F.lit("1995-01-02").cast("date"), k % 500)
    one = s.select(base.code_of(c("s_suppkey")).alias("entity_code"), start.alias("in_date"), F.when(k % 3 != 0, F.date_add(start, 700 + k % 300)).alias("out_date"), F.concat(F.lit("i"), (c("s_nationkey")).cast("string")).alias("industry"))
    two = s.where(k % 4 == 0).select(base.code_of(c("s_suppkey")).alias("entity_code"), F.date_add(start, 600).alias("in_date"), F.lit(None).cast("date").alias("out_date"), F.concat(F.lit("i"), ((c("s_nationkey") + 1) % 25).cast("string")).alias("industry"))
    return one.unionByName(two)


MEM = f"""mem AS (SELECT {CODE.format(k="s_suppkey")} AS entity_code, DATE '1995-01-02' + (s_suppkey % 500)::INT AS in_date, CASE WHEN s_suppkey % 3 <> 0 THEN DATE '1995-01-02' + (s_suppkey % 500 + 700 + s_suppkey % 300)::INT END AS out_date, 'i' || s_nationkey::VARCHAR AS industry FROM supplier
 UNION ALL SELECT {CODE.format(k="s_suppkey")}, DATE '1995-01-02' + (s_suppkey % 500 + 600)::INT, NULL, 'i' || ((s_nationkey + 1) % 25)::VARCHAR FROM supplier WHERE s_suppkey % 4 = 0)"""


@R.add("j_membership", K, sql=f"WITH {BARS}, {CAL}, {MEM} SELECT DISTINCT entity_code, trade_date FROM cal JOIN mem ON trade_date >= in_date AND (out_date IS NULL OR trade_date <= out_date)")
def _(spark, sf):
    return j.membership(cal(spark, sf), members(spark, sf))


@R.add("j_membership_all", K, sql=f"WITH {BARS} SELECT entity_code, trade_date FROM bars WHERE entity_code IN (SELECT {CODE.format(k='s_suppkey')} FROM supplier WHERE s_nationkey % 2 = 1)")
def _(spark, sf):
    return j.membership_all(bars(spark, sf), basics(spark, sf))


@R.add("j_filter_universe", "entity_code signal_date", "close", sql=f"""
WITH {BARS}, {MEM} SELECT entity_code, trade_date AS signal_date, close FROM bars b WHERE EXISTS (SELECT 1 FROM mem m WHERE m.entity_code = b.entity_code AND b.trade_date >= in_date AND (out_date IS NULL OR b.trade_date <= out_date))""")
def _(spark, sf):
    return j.filter_universe(bars(spark, sf).withColumnRenamed("trade_date", "signal_date"), j.membership(cal(spark, sf), members(spark, sf)))


def industry_weights(spark, sf):
    """Exact-date weights of the nation of a supplier; a few bars have none."""
    own = table(spark, sf, "supplier").select(base.code_of(c("s_suppkey")).alias("entity_code"), F.concat(F.lit("x"), c("s_nationkey").cast("string")).alias("index_code"))
    p = panel(spark, sf).select("entity_code", "trade_date", "nth", "volume")
    return p.join(own, "entity_code").withColumn("weight", F.when(c("nth") % 20 == 0, 0.0).otherwise(c("volume")))


def industry_base(spark, sf):
    n = table(spark, sf, "nation")
    return n.select(F.concat(F.lit("x"), c("n_nationkey").cast("string")).alias("index_code"), F.lit("1").alias("level_type"), c("n_name").alias("level1_name"))


IND = f"""{PANEL}, ind AS (SELECT p.entity_code, p.trade_date, n.n_name AS industry, p.volume AS industry_weight FROM panel p JOIN supplier s ON {CODE.format(k="s.s_suppkey")} = p.entity_code JOIN nation n ON n.n_nationkey = s.s_nationkey WHERE p.nth % 20 <> 0)"""


@R.add("j_industry_daily", K + " industry", sql=f"WITH {IND} SELECT * FROM ind")
def _(spark, sf):
    return j.industry_daily(bars(spark, sf).select("entity_code", "trade_date"), industry_weights(spark, sf), industry_base(spark, sf), 0.5, first="1990-01-01")


@R.add("j_industry_interval", K + " industry", sql=f"""
WITH {BARS}, {MEM}, x AS (SELECT b.entity_code, b.trade_date, m.industry, row_number() OVER (PARTITION BY b.entity_code, b.trade_date ORDER BY in_date DESC NULLS LAST, industry DESC NULLS LAST) AS r
 FROM bars b LEFT JOIN mem m ON m.entity_code = b.entity_code AND b.trade_date >= in_date AND (out_date IS NULL OR b.trade_date <= out_date)) SELECT * FROM x WHERE r = 1""")
def _(spark, sf):
    return j.industry_interval(bars(spark, sf).select("entity_code", "trade_date"), members(spark, sf))


@R.add("j_sample_filters", K, "close", sql=f"""
WITH {PANEL}, {CAL}, f AS (SELECT entity_code, min(trade_date) AS ipo, CASE WHEN min(k) % 10 = 3 THEN DATE '2000-01-03' END AS out_date FROM panel GROUP BY 1)
SELECT p.* FROM panel p JOIN f USING (entity_code) JOIN cal USING (trade_date) JOIN (SELECT trade_date AS ipo, idx AS ipo_idx FROM cal) i USING (ipo)
WHERE cal.idx - ipo_idx >= 60 AND (out_date IS NULL OR p.trade_date < out_date) AND is_st = 0 AND is_wd = 0 AND is_susp = 0 AND entity_code NOT LIKE '%.BJ' AND NOT (entity_code LIKE '688%.SH' OR entity_code LIKE '689%.SH' OR entity_code LIKE '30_%.SZ')""")
def _(spark, sf):
    p = panel(spark, sf).withColumns({"buy_allowed": 1 - c("is_susp"), "sell_allowed": 1 - c("is_susp")})
    k = F.min(entity_number())
    listed = p.groupBy("entity_code").agg(F.min("trade_date").alias("ipo_date"), F.when(k % 10 == 3, F.lit("2000-01-03").cast("date")).alias("out_date"))
    return j.sample_filters(p, listed, cal(spark, sf), boards=("Main",))


@R.add("j_known_at", K + " factor_id run_id", "value", "factor_version", sql=f"WITH {VALUES} SELECT * FROM vals WHERE available_at <= TIMESTAMP '1999-06-01 12:00:00'")
def _(spark, sf):
    return j.as_known_at(values(spark, sf), F.lit("1999-06-01 12:00:00").cast("timestamp_ntz"))


@R.add("j_event_cutoff", K + " factor_id run_id", "value", "factor_version", sql=f"WITH {VALUES} SELECT * FROM vals WHERE event_available_at <= trade_date + INTERVAL 15 HOUR")
def _(spark, sf):
    return j.as_of_event(values(spark, sf), per_row=True)


@R.add("j_sentinel", "name", sql=f"""
WITH {BARS}, d AS (SELECT max(trade_date) AS d FROM bars), s AS (SELECT * FROM (VALUES ('safe', 0, 0), ('late write', 0, 1), ('late event', 1, 0)) t(name, e, w))
SELECT name FROM s, d WHERE d + to_days(e) <= d AND d + to_days(w) <= d""")
def _(spark, sf):
    """Of three probe rows of the last date only the one known in time may pass both cutoffs."""
    day = bars(spark, sf).agg(F.max("trade_date").alias("trade_date"))
    probes = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(e).alias("e"), F.lit(w).alias("w")) for n, e, w in (("safe", 0, 0), ("late write", 0, 1), ("late event", 1, 0))]))
    rows = day.select("trade_date", probes.alias("p")).select("trade_date", "p.*")
    rows = rows.withColumns({"event_available_at": c("trade_date").cast("timestamp") + F.make_dt_interval("e", F.lit(15)), "available_at": c("trade_date").cast("timestamp") + F.make_dt_interval("w", F.lit(15))})
    return j.as_of_event(j.as_known_at(rows, c("trade_date").cast("timestamp") + F.expr("INTERVAL 15 HOURS")), per_row=True)


@R.add("j_latest_rows", K + " factor_id run_id", "value", sql=f"""
WITH {VALUES}, r AS (SELECT *, row_number() OVER (PARTITION BY entity_code, trade_date, factor_id, factor_version ORDER BY computed_at DESC, updated_at DESC) AS n FROM vals) SELECT * FROM r WHERE n = 1""")
def _(spark, sf):
    return j.latest_rows(values(spark, sf), ("entity_code", "trade_date", "factor_id", "factor_version"))


@R.add("j_latest_predictions", K + " model_id run_id", "value", sql=f"""
WITH {VALUES}, r AS (SELECT *, factor_id AS model_id, row_number() OVER (PARTITION BY entity_code, trade_date, factor_id ORDER BY updated_at DESC, computed_at DESC, run_id DESC) AS n FROM vals WHERE factor_version = 1) SELECT * FROM r WHERE n = 1""")
def _(spark, sf):
    return j.latest_predictions(values(spark, sf).where("factor_version = 1").withColumnRenamed("factor_id", "model_id"))


@R.add("j_final", K, "", "top", sql=f"WITH {VALUES} SELECT entity_code, trade_date, max(updated_at)::DATE - DATE '1990-01-01' AS top FROM vals GROUP BY ALL")
def _(spark, sf):
    f = j.final(values(spark, sf), ("entity_code", "trade_date"))
    return f.withColumn("top", F.date_diff(c("updated_at").cast("date"), F.lit("1990-01-01").cast("date")))


@R.add("j_final_rows", K + " factor_id run_id", "value", "factor_version", sql=f"""
WITH {VALUES}, r AS (SELECT *, row_number() OVER (PARTITION BY entity_code, trade_date, factor_id, factor_version ORDER BY updated_at DESC, run_id DESC) AS n FROM vals) SELECT * FROM r WHERE n = 1""")
def _(spark, sf):
    return j.final(values(spark, sf), ("entity_code", "trade_date", "factor_id", "factor_version"))


@R.add("j_revision", "params_hash", "", "factor_version rows", sql=f"""
WITH {VALUES} SELECT factor_version, params_hash, count(*) AS rows FROM vals WHERE factor_id = 'size' AND trade_date BETWEEN DATE '1998-01-01' AND DATE '1999-01-01' GROUP BY ALL ORDER BY factor_version DESC, max(computed_at) DESC, params_hash LIMIT 1""")
def _(spark, sf):
    return j.signal_revision(values(spark, sf).where("factor_id = 'size'"), "1998-01-01", "1999-01-01")


SIG = f"""{VALUES}, sg AS (SELECT *, greatest(trade_date, event_available_at::DATE) AS signal_date FROM vals WHERE factor_id = 'drift' AND run_id = 'run1'),
sig AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity_code, signal_date ORDER BY trade_date DESC) AS n FROM sg) WHERE n = 1)"""


def signals(spark, sf):
    return j.signal_dates(values(spark, sf).where("factor_id = 'drift' and run_id = 'run1'"))


@R.add("j_signal_dates", K + " signal_date", "value", sql=f"WITH {SIG} SELECT * FROM sig")
def _(spark, sf):
    return signals(spark, sf)


@R.add("j_next_session", "entity_code signal_date trade_date", "value", sql=f"""
WITH {SIG}, {CAL} SELECT s.entity_code, s.signal_date, s.value, (SELECT min(c.trade_date) FROM cal c WHERE c.trade_date > s.signal_date) AS trade_date FROM sig s WHERE s.signal_date < (SELECT max(trade_date) FROM cal)""")
def _(spark, sf):
    return j.next_session(signals(spark, sf).drop("trade_date"), cal(spark, sf))


@R.add("j_range", "start_date end_date", sql=f"""
WITH {VALUES}, e AS (SELECT factor_id, min(trade_date) AS lo, max(trade_date) AS hi FROM vals WHERE value IS NOT NULL GROUP BY 1), b AS (SELECT min(trade_date) AS blo, max(trade_date) AS bhi FROM bars WHERE entity_code = '000001.SZ')
SELECT greatest(max(lo), any_value(blo)) AS start_date, least(min(hi), any_value(bhi)) AS end_date FROM e, b""")
def _(spark, sf):
    return j.backtest_range(values(spark, sf).where("value is not null"), bars(spark, sf).where("entity_code = '000001.SZ'"))


@R.add("j_ready_dates", "trade_date", "share", "members ready", sql=f"""
WITH {PANEL}, {CAL}, {MEM}, m AS (SELECT DISTINCT entity_code, trade_date FROM cal JOIN mem ON trade_date >= in_date AND (out_date IS NULL OR trade_date <= out_date))
SELECT trade_date, count(*) AS members, count(*) FILTER (p.close IS NOT NULL AND p.pre_close IS NOT NULL) AS ready, count(*) FILTER (p.close IS NOT NULL AND p.pre_close IS NOT NULL) / count(*)::DOUBLE AS share
FROM m LEFT JOIN panel p USING (entity_code, trade_date) GROUP BY 1 HAVING share >= 0.8""")
def _(spark, sf):
    return j.ready_dates(j.membership(cal(spark, sf), members(spark, sf)), panel(spark, sf), ["close", "pre_close"])


@R.add("j_common_dates", "trade_date", "", "entities", sql=f"""
WITH {VALUES}, f AS (SELECT entity_code, trade_date FROM vals WHERE factor_id IN ('size', 'drift') AND value IS NOT NULL GROUP BY ALL HAVING count(DISTINCT factor_id) = 2) SELECT trade_date, count(*) AS entities FROM f GROUP BY 1""")
def _(spark, sf):
    return j.common_dates(values(spark, sf).where("value is not null").withColumnRenamed("factor_id", "model_id"), ["size", "drift"])


@R.add("j_compare_keys", "", "", "both_sides left_only right_only", sql=f"""
WITH {PANEL}, a AS (SELECT entity_code, trade_date, 1 AS x FROM panel WHERE k % 4 <> 0), b AS (SELECT entity_code, trade_date, 1 AS y FROM panel WHERE k % 6 <> 0)
SELECT count(*) FILTER (x = 1 AND y = 1) AS both_sides, count(*) FILTER (y IS NULL) AS left_only, count(*) FILTER (x IS NULL) AS right_only FROM a FULL JOIN b USING (entity_code, trade_date)""")
def _(spark, sf):
    p = panel(spark, sf)
    return j.compare_keys(p.where(entity_number() % 4 != 0), p.where(entity_number() % 6 != 0)).withColumnRenamed("both", "both_sides")
