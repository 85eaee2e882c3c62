"""Queries of sources, value tables and data quality."""

from pyspark.sql import functions as F

from ..operators import quality as v
from ..sources import panel as src
from . import base
from .base import BARS, CODE, PANEL, Registry, bars, entity_number, panel, table

R = Registry()
K = "entity_code trade_date"
c = F.col


@R.add("s_bars", K, "open high low close volume amount", sql=f"WITH {BARS} SELECT * FROM bars")
def _(spark, sf):
    return bars(spark, sf)


def status_extras(spark, sf):
    """Status and extra fields as text, some bars without, some twice."""
    p = panel(spark, sf)
    k = entity_number()
    status = p.where(k % 5 != 4).select("entity_code", "trade_date", "pre_close", *[F.when(c(f) == 1, F.when(c("nth") % 2 == 0, "1").otherwise("True")).otherwise("0").alias(f) for f in ("is_st", "is_susp", "is_wd")])
    turn = F.when(k % 4 == 0, F.lit("n/a")).otherwise(F.floor("volume").cast("string"))
    extras = p.where(k % 3 != 2).select("entity_code", "trade_date", turn.alias("turn"), c("pre_close").cast("string").alias("pre_close"), F.when(c("nth") % 13 == 0, "0").otherwise("1").alias("tradestatus"))
    return status.unionByName(status.where(k % 7 == 0)), extras.unionByName(extras.where(k % 6 == 0))


@R.add("s_panel", K, "close pre_close turn", "is_st is_susp is_wd is_kcb is_cyb is_bjs", sql=f"""
WITH {PANEL} SELECT entity_code, trade_date, close, CASE WHEN k % 5 <> 4 OR k % 3 <> 2 THEN pre_close END AS pre_close, CASE WHEN k % 3 <> 2 AND k % 4 <> 0 THEN floor(volume) END AS turn,
 CASE WHEN k % 5 <> 4 THEN is_st ELSE 0 END AS is_st, (k % 5 <> 4 AND is_susp = 1 OR k % 3 <> 2 AND nth % 13 = 0)::INT AS is_susp, CASE WHEN k % 5 <> 4 THEN is_wd ELSE 0 END AS is_wd,
 (entity_code LIKE '688%.SH')::INT AS is_kcb, (entity_code LIKE '300%.SZ')::INT AS is_cyb, (entity_code LIKE '%.BJ')::INT AS is_bjs FROM panel""")
def _(spark, sf):
    return src.panel(bars(spark, sf), *status_extras(spark, sf))


@R.add("s_basics", "entity_code type", sql=f"SELECT {CODE.format(k='s_suppkey')} AS entity_code, (s_nationkey % 2)::VARCHAR AS type FROM supplier")
def _(spark, sf):
    return basics(spark, sf)


def basics(spark, sf):
    return src.basics(table(spark, sf, "supplier").select(base.code_of(c("s_suppkey")).alias("code"), (c("s_nationkey") % 2).alias("type")))


@R.add("s_history", K, "open high low close volume", sql=f"""
WITH {BARS} SELECT * FROM bars WHERE entity_code = '000001.SZ' AND trade_date <= DATE '2000-06-30' AND least(open, high, low, close) > 0 ORDER BY trade_date DESC LIMIT 60""")
def _(spark, sf):
    return src.market_history(bars(spark, sf), "000001.SZ", "2000-06-30", 60)


def cal(spark, sf):
    return base.once("cal", lambda: src.calendar(bars(spark, sf)))


CAL = "cal AS (SELECT trade_date, row_number() OVER (ORDER BY trade_date) - 1 AS idx FROM (SELECT DISTINCT trade_date FROM bars))"


@R.add("s_calendar", "trade_date", "", "idx", sql=f"WITH {BARS}, {CAL} SELECT * FROM cal")
def _(spark, sf):
    return cal(spark, sf)


@R.add("s_sessions", "trade_date", "", "idx", sql=f"WITH {BARS}, {CAL} SELECT * FROM cal WHERE trade_date <= DATE '1999-12-27' ORDER BY trade_date DESC LIMIT 10")
def _(spark, sf):
    return src.sessions_ending_at(cal(spark, sf), "1999-12-27", 10)


@R.add("s_range", "first_date last_date default_start default_end", sql=f"WITH {BARS} SELECT min(trade_date) AS first_date, max(trade_date) AS last_date, max(trade_date) AS default_start, max(trade_date) AS default_end FROM bars")
def _(spark, sf):
    return src.source_range(bars(spark, sf))


@R.add("s_profile", "field first_date last_date", "filled_pct", "rows entities", sql=f"""
WITH {PANEL} {" UNION ALL ".join(f"SELECT '{f}' AS field, count(*) AS rows, count(DISTINCT entity_code) AS entities, min(trade_date) AS first_date, max(trade_date) AS last_date, count({f}) * 100.0 / count(*) AS filled_pct FROM panel" for f in ("close", "pre_close", "pe"))}""")
def _(spark, sf):
    return src.source_profile(panel(spark, sf), ["close", "pre_close", "pe"])


@R.add("s_fields", K, "extra hot", sql=f"WITH {PANEL} SELECT *, CASE WHEN k % 3 = 0 THEN volume + 1 END AS extra, CASE WHEN k % 3 = 0 THEN (close > open)::INT END AS hot FROM panel")
def _(spark, sf):
    p = panel(spark, sf)
    extra = p.where(entity_number() % 3 == 0).select("entity_code", "trade_date", (c("volume") + 1).cast("string").alias("extra"), (c("close") > c("open")).alias("hot"))
    return src.with_fields(p, extra, ["extra", "hot"])


@R.add("s_latest_name", "entity_code name", sql=f"""
WITH n AS (SELECT {CODE.format(k="l_suppkey")} AS entity_code, CASE WHEN l_quantity > 10 THEN l_returnflag || l_linestatus ELSE '' END AS name, l_shipdate::DATE AS snapshot_date FROM lineitem),
m AS (SELECT *, row_number() OVER (PARTITION BY entity_code ORDER BY snapshot_date DESC, name DESC) AS r FROM n WHERE trim(name) <> '') SELECT * FROM m WHERE r = 1""")
def _(spark, sf):
    t = table(spark, sf, "lineitem")
    name = F.when(c("l_quantity") > 10, F.concat("l_returnflag", "l_linestatus")).otherwise("")
    return src.latest_name(t.select(base.code_of(c("l_suppkey")).alias("entity_code"), name.alias("name"), F.to_date("l_shipdate").alias("snapshot_date")))


# --- value tables: every bar twice, written at two times, under two versions of two factors ---


def values(spark, sf):
    p = panel(spark, sf)
    k, day = entity_number(), c("trade_date").cast("timestamp_ntz")
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("factor_id"), F.lit(n).alias("factor_version"), x.alias("raw_value")) for f, n, x in (("size", 1, c("amount")), ("size", 2, c("amount") * 2), ("drift", 1, c("pct_chg")))]))
    two = F.explode(F.array(F.lit(0), F.lit(1)))
    v = p.select("entity_code", "trade_date", "nth", k.alias("k"), each.alias("v")).select("*", two.alias("again"))
    return v.select(
        "entity_code", "trade_date", "v.*", F.concat(F.lit("p"), (c("k") % 2).cast("string")).alias("params_hash"), (c("v.raw_value") + c("again")).alias("value"),
        (day + F.expr("INTERVAL 15 HOURS") + F.make_dt_interval((c("k") % 3).cast("int"))).alias("event_available_at"),
        (day + F.expr("INTERVAL 1 DAY") + F.make_dt_interval((c("again") * 30).cast("int"))).alias("available_at"),
        (day + F.make_dt_interval((c("again") * 30).cast("int"))).alias("computed_at"),
        (day + F.make_dt_interval((c("again") * (c("nth") % 2)).cast("int"))).alias("updated_at"),
        F.concat(F.lit("run"), c("again").cast("string")).alias("run_id"),
    )


VALUES = f"""{PANEL}, v0 AS (SELECT entity_code, trade_date, nth, k, unnest([{{'f': 'size', 'n': 1, 'x': amount}}, {{'f': 'size', 'n': 2, 'x': amount * 2}}, {{'f': 'drift', 'n': 1, 'x': pct_chg}}]) AS v FROM panel),
v1 AS (SELECT *, unnest([0, 1]) AS again FROM v0),
vals AS (SELECT entity_code, trade_date, v.f AS factor_id, v.n::INT AS factor_version, v.x AS raw_value, 'p' || (k % 2)::VARCHAR AS params_hash, v.x + again AS value,
 trade_date + INTERVAL 15 HOUR + to_days((k % 3)::INT) AS event_available_at, trade_date + INTERVAL 1 DAY + to_days(again * 30) AS available_at, trade_date + to_days(again * 30) AS computed_at,
 trade_date + to_days((again * (nth % 2))::INT) AS updated_at, 'run' || again::VARCHAR AS run_id FROM v1)"""


@R.add("v_list", K + " factor_id", "value", "factor_version", sql=f"""
WITH {VALUES}, mx AS (SELECT factor_id, max(factor_version) AS factor_version FROM vals GROUP BY 1)
SELECT * FROM vals JOIN mx USING (factor_id, factor_version) WHERE factor_id = 'size' AND trade_date >= DATE '1999-01-01' ORDER BY trade_date DESC, entity_code, computed_at LIMIT 100 OFFSET 50""")
def _(spark, sf):
    return v.list_values(values(spark, sf), {"factor_id": "size", "start": "1999-01-01"}, [("trade_date", "desc"), ("entity_code", "asc"), ("computed_at", "asc")], 100, 50)


@R.add("v_count", "latest_date", "", "n", sql=f"WITH {VALUES} SELECT count(*) AS n, max(trade_date) AS latest_date FROM vals WHERE factor_id = 'drift'")
def _(spark, sf):
    return v.count_values(values(spark, sf), {"factor_id": "drift"})


@R.add("v_coverage", "first_date last_date", "", "rows entities dates", sql=f"""
WITH {VALUES} SELECT count(*) AS rows, count(DISTINCT entity_code) AS entities, count(DISTINCT trade_date) AS dates, min(trade_date) AS first_date, max(trade_date) AS last_date FROM vals WHERE factor_id = 'drift'""")
def _(spark, sf):
    return v.coverage(values(spark, sf), {"factor_id": "drift"})


@R.add("v_sync_states", "factor_id params_hash first_date last_date", "", "rows entities dates", sql=f"""
WITH {VALUES} SELECT factor_id, params_hash, count(*) AS rows, count(DISTINCT entity_code) AS entities, count(DISTINCT trade_date) AS dates, min(trade_date) AS first_date, max(trade_date) AS last_date FROM vals GROUP BY ALL""")
def _(spark, sf):
    return v.sync_states(values(spark, sf), ["factor_id", "params_hash"])


@R.add("v_quality", "metric status", "min max avg std null_ratio zero_ratio", "rows nulls zeros", sql=f"""
WITH {VALUES}, l AS (SELECT 'raw_value' AS metric, raw_value AS x FROM vals UNION ALL SELECT 'value', value FROM vals)
SELECT metric, count(*) AS rows, count(*) - count(x) AS nulls, count(*) FILTER (x = 0) AS zeros, min(x) AS min, max(x) AS max, avg(x) AS avg, stddev_pop(x) AS std,
 (count(*) - count(x)) / count(*)::DOUBLE AS null_ratio, count(*) FILTER (x = 0) / count(*)::DOUBLE AS zero_ratio,
 CASE WHEN count(*) = 0 THEN 'empty' WHEN count(x) = 0 THEN 'not_generated' WHEN count(x) < count(*) THEN 'partial' ELSE 'generated' END AS status FROM l GROUP BY 1""")
def _(spark, sf):
    return v.quality(values(spark, sf), ["raw_value", "value"])


@R.add("v_cross_check", "", "max_diff", "left_rows right_rows joined mismatches", sql=f"""
WITH {BARS}, a AS (SELECT entity_code, trade_date, close AS x FROM bars), b AS (SELECT entity_code, trade_date, CASE WHEN volume > 100 THEN close + 1 ELSE close END AS y FROM bars WHERE volume > 10)
SELECT count(x) AS left_rows, count(y) AS right_rows, count(*) FILTER (x IS NOT NULL AND y IS NOT NULL) AS joined, count(*) FILTER (abs(x - y) > 1e-9) AS mismatches, max(abs(x - y)) AS max_diff FROM a FULL JOIN b USING (entity_code, trade_date)""")
def _(spark, sf):
    b = bars(spark, sf)
    other = b.where("volume > 10").select("entity_code", "trade_date", F.when(c("volume") > 100, c("close") + 1).otherwise(c("close")).alias("close"))
    return v.cross_check(b.select("entity_code", "trade_date", "close"), other, ["entity_code", "trade_date"], "close")


@R.add("v_persisted", "factor_id first_date last_date", "", "factor_version rows entities", sql=f"""
WITH {VALUES} SELECT factor_id, factor_version, count(*) AS rows, count(DISTINCT entity_code) AS entities, min(trade_date) AS first_date, max(trade_date) AS last_date FROM vals GROUP BY ALL""")
def _(spark, sf):
    return v.sync_states(values(spark, sf), ["factor_id", "factor_version"])


@R.add("v_result", "entity_code trade_date", "value", sql=f"""
WITH {VALUES}, f AS (SELECT *, row_number() OVER (PARTITION BY entity_code, trade_date ORDER BY updated_at DESC, computed_at DESC) AS r FROM vals WHERE factor_id = 'drift')
SELECT * FROM f WHERE r = 1 ORDER BY trade_date, entity_code LIMIT 200""")
def _(spark, sf):
    return v.read_result(values(spark, sf), {"factor_id": "drift"}, ["entity_code", "trade_date"], ["trade_date", "entity_code"], 200)


def runs(spark, sf):
    o = table(spark, sf, "orders")
    return o.select(F.concat(F.lit("m"), (c("o_custkey") % 12).cast("string")).alias("model_id"), (c("o_orderkey") % 3).cast("int").alias("model_version"), c("o_orderdate").alias("finished_at"), c("o_orderkey").alias("run_id"), F.when(c("o_orderstatus") == "F", "success").otherwise("failed").alias("status"), F.when(c("o_custkey") % 5 == 0, "smoke").otherwise("full").alias("profile"), (c("o_orderkey") % 7 == 0).alias("research_only"))


@R.add("v_latest_runs", "model_id", "", "model_version run_id", sql="""
WITH r AS (SELECT 'm' || (o_custkey % 12)::VARCHAR AS model_id, o_orderkey % 3 AS model_version, o_orderkey AS run_id, o_orderdate FROM orders WHERE o_orderstatus = 'F' AND o_custkey % 5 <> 0 AND o_orderkey % 7 <> 0),
q AS (SELECT *, row_number() OVER (PARTITION BY model_id, model_version ORDER BY o_orderdate DESC, run_id DESC) AS n FROM r) SELECT * FROM q WHERE n = 1""")
def _(spark, sf):
    return v.latest_runs(runs(spark, sf))


# --- definitions: a factor for each brand, versions by size ---


def definitions(spark, sf):
    p = table(spark, sf, "part")
    return p.select(c("p_brand").alias("factor_id"), c("p_size").alias("version"), c("p_type").alias("expression"), c("p_retailprice").alias("updated_at"), c("p_partkey").alias("seq"), (c("p_partkey") % 4 != 0).alias("enabled"))


@R.add("i_latest", "factor_id expression", "", "version seq", sql="""
WITH d AS (SELECT p_brand AS factor_id, p_size AS version, p_type AS expression, p_partkey AS seq, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_retailprice DESC, p_partkey DESC) AS r FROM part WHERE p_partkey % 4 <> 0) SELECT * FROM d WHERE r = 1""")
def _(spark, sf):
    return v.latest_definitions(definitions(spark, sf).where("enabled"))


@R.add("i_versions", "factor_id versions", sql="SELECT p_brand AS factor_id, list_reverse_sort(list(DISTINCT p_size)) AS versions FROM part GROUP BY 1")
def _(spark, sf):
    return v.versions(definitions(spark, sf))


@R.add("i_resolve", "factor_id", "", "requested version seq", sql="""
WITH q AS (SELECT DISTINCT p_brand AS factor_id, CASE WHEN p_size % 2 = 0 THEN p_size END AS requested FROM part),
d AS (SELECT p_brand AS factor_id, p_size AS version, max_by(p_partkey, struct_pack(a := p_retailprice, b := p_partkey)) AS seq FROM part GROUP BY ALL), m AS (SELECT factor_id, max(version) AS top FROM d GROUP BY 1)
SELECT q.factor_id, q.requested, d.version, d.seq FROM q JOIN m USING (factor_id) JOIN d ON d.factor_id = q.factor_id AND d.version = coalesce(q.requested, m.top)""")
def _(spark, sf):
    d = definitions(spark, sf)
    asked = d.select("factor_id", F.when(c("version") % 2 == 0, c("version")).alias("requested")).distinct()
    return v.resolve(d, asked)


@R.add("i_by_update", "factor_id expression", "", "version", sql="""
SELECT p_brand AS factor_id, max_by(p_type, struct_pack(a := p_retailprice, b := p_partkey)) AS expression, max_by(p_size, struct_pack(a := p_retailprice, b := p_partkey)) AS version FROM part GROUP BY 1""")
def _(spark, sf):
    return v.definitions_by_update(definitions(spark, sf))


@R.add("i_changes", "factor_id change", "", "version", sql="""
WITH d AS (SELECT *, row_number() OVER (PARTITION BY p_brand, p_size ORDER BY p_retailprice DESC, p_partkey DESC) AS r FROM part),
e AS (SELECT p_brand AS factor_id, p_size AS version, p_type AS expression FROM d WHERE r = 1 AND p_size <= 40), n AS (SELECT p_brand AS factor_id, p_size AS version, CASE WHEN p_size % 3 = 0 THEN 'X' ELSE p_type END AS expression FROM d WHERE r = 1 AND p_size >= 20),
m AS (SELECT factor_id, max(version) AS top FROM e GROUP BY 1)
SELECT n.factor_id, n.version, CASE WHEN m.top IS NULL OR e.version IS NULL AND n.version > m.top THEN 'create' WHEN e.version IS NULL THEN 'conflict' WHEN e.expression = n.expression THEN 'unchanged' WHEN n.version = m.top THEN 'updated' ELSE 'conflict' END AS change
FROM n LEFT JOIN m USING (factor_id) LEFT JOIN e ON e.factor_id = n.factor_id AND e.version = n.version""")
def _(spark, sf):
    d = definitions(spark, sf)
    one = v.definitions_per_version(d)
    return v.definition_changes(one.where("version <= 40"), one.where("version >= 20").withColumn("expression", F.when(c("version") % 3 == 0, "X").otherwise(c("expression"))))


@R.add("i_upsert", "factor_id expression", "", "version seq", sql="""
WITH d AS (SELECT *, row_number() OVER (PARTITION BY p_brand, p_size ORDER BY p_retailprice DESC, p_partkey DESC) AS r FROM part),
o AS (SELECT p_brand AS factor_id, p_size AS version, p_type AS expression, p_partkey AS seq FROM d WHERE r = 1), m AS (SELECT factor_id, max(version) AS top FROM o WHERE version <= 40 GROUP BY 1)
SELECT o.factor_id, o.version, o.seq, CASE WHEN o.version = m.top THEN 'X' ELSE o.expression END AS expression FROM o LEFT JOIN m USING (factor_id)""")
def _(spark, sf):
    one = v.definitions_per_version(definitions(spark, sf))
    old = one.where("version <= 40")
    changed = v.latest_definitions(old).withColumn("expression", F.lit("X"))
    return v.upsert_definition(old, one.where("version > 40").unionByName(changed.select(*one.columns)))
