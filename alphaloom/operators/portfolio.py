"""Rule-based portfolios: targets, drifting holdings, turnover, net asset value, performance.

Returns of a holding period have a closed form, weight times the product of gross returns, so nothing is simulated day
by day. Blocked entries are filtered up front; blocked exits are assumed to trade, and are counted. Windows over all
dates run on one row per date and key.
"""

from __future__ import annotations

from functools import reduce
from operator import add, and_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import market_regime
from .evaluate import rank_corr

#: Cost rates of buying and selling, trading days of a year.
BUY, SELL, YEAR = 0.0003, 0.0013, 252
EPS = 1e-8


def open_returns(bars: DataFrame, cal: DataFrame, price: str = "adjusted_open") -> DataFrame:
    """(entity_code, trade_date, idx, ret): next open over this one, minus 1, on every session from the first bar on.

    Missing opens are carried forward; the last session has no return.
    """
    own = bars.join(cal, "trade_date").select("entity_code", "idx", F.col(price).alias("price"))
    last = cal.agg(F.max("idx").alias("z"))
    grid = own.groupBy("entity_code").agg(F.min("idx").alias("a")).crossJoin(last).select("entity_code", F.explode(F.sequence("a", "z")).alias("idx"))
    w = Window.partitionBy("entity_code").orderBy("idx")
    filled = grid.join(own, ["entity_code", "idx"], "left").withColumn("price", F.last("price", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    ret = filled.withColumn("ret", F.try_divide(F.lead("price").over(w), F.col("price")) - 1)
    return ret.join(cal, "idx").select("entity_code", "trade_date", "idx", "ret").where("ret is not null")


def trade_flags(panel: DataFrame, price: str = "open") -> DataFrame:
    """Adds buy_allowed and sell_allowed: not suspended; not at the upper, the lower limit."""
    on = F.coalesce(F.col("is_susp"), F.lit(0)) == 0
    up = F.coalesce(F.col(price) >= F.col("high_limited") - EPS, F.lit(False))
    down = F.coalesce(F.col(price) <= F.col("low_limited") + EPS, F.lit(False))
    return panel.withColumns({"buy_allowed": (on & ~up).cast("int"), "sell_allowed": (on & ~down).cast("int")})


def quintile_targets(signals: DataFrame, least: int = 25, k: int = 5, keys: tuple[str, ...] = ()) -> DataFrame:
    """signals (keys, trade_date, entity_code, score) -> with bucket and weight: k groups in the order of score, then code.

    Groups have max(1, n div k) names, the last one the rest; dates with fewer than `least` names have no targets.
    """
    day = Window.partitionBy(*keys, "trade_date")
    sized = signals.withColumns({"__n": F.count(F.lit(1)).over(day), "__pos": F.row_number().over(day.orderBy("score", "entity_code")) - 1}).where(F.col("__n") >= least)
    size = F.greatest(F.lit(1), F.floor(F.col("__n") / k))
    grouped = sized.withColumn("bucket", F.least(F.floor(F.col("__pos") / size), F.lit(k - 1)).cast("int") + 1)
    return grouped.withColumn("weight", 1 / F.count(F.lit(1)).over(Window.partitionBy(*keys, "trade_date", "bucket"))).drop("__n", "__pos")


def topn_targets(signals: DataFrame, n: int, every: int = 1, keys: tuple[str, ...] = ()) -> DataFrame:
    """The n names of highest score, ties by code, on every `every`-th date; dates with fewer names have no targets."""
    days = signals.select(*keys, "trade_date").distinct()
    own = Window.partitionBy(*keys).orderBy("trade_date") if keys else Window.orderBy("trade_date")
    chosen = days.withColumn("__i", F.row_number().over(own) - 1).where(F.col("__i") % every == 0).drop("__i")
    day = Window.partitionBy(*keys, "trade_date")
    ranked = signals.join(chosen, [*keys, "trade_date"], "left_semi").withColumns({"__n": F.count(F.lit(1)).over(day), "__r": F.row_number().over(day.orderBy(F.col("score").desc(), "entity_code"))})
    return ranked.where((F.col("__n") >= n) & (F.col("__r") <= n)).withColumn("weight", F.lit(1.0 / n)).drop("__n", "__r")


def target_ic(signals: DataFrame, returns: DataFrame) -> DataFrame:
    """(trade_date, n, ic) of score against the return that follows."""
    return rank_corr(signals.join(returns.select("entity_code", "trade_date", "ret"), ["entity_code", "trade_date"]), ["trade_date"], "score", "ret")


def _held(targets: DataFrame, returns: DataFrame, cal: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Targets on each session until the next rebalance: (keys, start, idx, entity_code, value, ret, grown).

    value is the weight grown until the session's open, grown that after it. A missing return counts as 0.
    """
    starts = targets.select(*keys, "trade_date").distinct().join(cal, "trade_date").crossJoin(cal.agg(F.max("idx").alias("last")))
    order = Window.partitionBy(*keys).orderBy("idx") if keys else Window.orderBy("idx")
    spans = starts.withColumn("until", F.coalesce(F.lead("idx").over(order), F.col("last")) - 1)
    spans = spans.where("until >= idx").select(*keys, "trade_date", F.col("idx").alias("start"), F.explode(F.sequence("idx", "until")).alias("idx"))
    held = targets.join(spans, [*keys, "trade_date"]).drop("trade_date")
    held = held.join(returns.select("entity_code", "idx", "ret"), ["entity_code", "idx"], "left").withColumn("ret", F.coalesce("ret", F.lit(0.0)))
    own = Window.partitionBy(*keys, "start", "entity_code").orderBy("idx")
    log = F.log1p("ret")
    before = F.coalesce(F.sum(log).over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return held.withColumn("value", F.col("weight") * F.exp(before)).withColumn("grown", F.col("value") * (1 + F.col("ret")))


def portfolio_returns(targets: DataFrame, returns: DataFrame, cal: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """targets (keys, trade_date, entity_code, weight), returns (entity_code, idx, ret) -> (keys, trade_date, ret, names).

    Holdings drift between rebalances; weights that do not sum to 1 are taken relative to each other.
    """
    held = _held(targets, returns, cal, keys)
    daily = held.groupBy(*keys, "idx").agg((F.sum("grown") / F.sum("value") - 1).alias("ret"), F.count("*").alias("names"))
    return daily.join(cal, "idx").select(*keys, "trade_date", "ret", "names")


def turnover_cost(targets: DataFrame, returns: DataFrame, cal: DataFrame, keys: tuple[str, ...] = (), buy: float = BUY, sell: float = SELL) -> DataFrame:
    """(keys, trade_date, turnover, cost) per rebalance: target weights against those that drifted until then."""
    held = _held(targets, returns, cal, keys)
    end = Window.partitionBy(*keys, "start", "entity_code").orderBy(F.col("idx").desc())
    last = held.withColumn("__r", F.row_number().over(end)).where("__r = 1")
    total = Window.partitionBy(*keys, "start")
    old = last.select(*keys, (F.col("idx") + 1).alias("idx"), "entity_code", (F.col("grown") / F.sum("grown").over(total)).alias("old"))
    new = targets.join(cal, "trade_date").select(*keys, "idx", "entity_code", F.col("weight").alias("new"))
    starts = new.select(*keys, "idx").distinct()
    met = new.join(old.join(starts, [*keys, "idx"], "left_semi"), [*keys, "idx", "entity_code"], "full_outer").fillna(0.0, ["old", "new"])
    bought, sold = F.sum(F.greatest(F.col("new") - F.col("old"), F.lit(0.0))), F.sum(F.greatest(F.col("old") - F.col("new"), F.lit(0.0)))
    s = met.groupBy(*keys, "idx").agg(((bought + sold) / 2).alias("turnover"), (bought * buy + sold * sell).alias("cost"))
    return s.join(cal, "idx").select(*keys, "trade_date", "turnover", "cost")


def nav(daily: DataFrame, keys: tuple[str, ...] = (), benchmark: DataFrame | None = None) -> DataFrame:
    """daily (keys, trade_date, ret) with nav, and with benchmark (trade_date, bench) bench_nav and excess.

    A session without a benchmark return leaves its value as it is.
    """
    w = (Window.partitionBy(*keys) if keys else Window.partitionBy()).orderBy("trade_date").rowsBetween(Window.unboundedPreceding, 0)
    out = daily.withColumn("nav", F.product(1 + F.col("ret")).over(w))
    if benchmark is not None:
        out = out.join(benchmark, "trade_date", "left").withColumn("bench_nav", F.product(1 + F.coalesce("bench", F.lit(0.0))).over(w))
        out = out.withColumn("excess", F.col("nav") / F.col("bench_nav") - 1)
    return out


def annualised(growth: Column, days: Column) -> Column:
    return F.when(growth > 0, F.pow(growth, YEAR / days) - 1).otherwise(-1.0)


def performance(daily: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, days, total, annual, max_drawdown, sharpe) of daily (keys, trade_date, ret)."""
    w = (Window.partitionBy(*keys) if keys else Window.partitionBy()).orderBy("trade_date").rowsBetween(Window.unboundedPreceding, 0)
    level = nav(daily, keys).withColumn("__peak", F.greatest(F.max("nav").over(w), F.lit(1.0)))
    s = level.groupBy(*keys).agg(F.count("*").alias("days"), F.max_by("nav", "trade_date").alias("nav"), F.min(F.col("nav") / F.col("__peak") - 1).alias("max_drawdown"), F.avg("ret").alias("__m"), F.stddev_samp("ret").alias("__s"))
    sharpe = F.when(F.col("__s") > 0, F.sqrt(F.lit(float(YEAR))) * F.col("__m") / F.col("__s"))
    return s.select(*keys, "days", (F.col("nav") - 1).alias("total"), annualised(F.col("nav"), F.col("days")).alias("annual"), "max_drawdown", sharpe.alias("sharpe"))


def benchmark_returns(bars: DataFrame, code: str) -> DataFrame:
    own = bars.where(F.col("entity_code") == code)
    ret = F.try_divide(F.lead("open").over(Window.partitionBy("entity_code").orderBy("trade_date")), F.col("open")) - 1
    return own.select("trade_date", ret.alias("bench")).where("bench is not null")


def monthly_returns(level: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """level (keys, trade_date, nav) -> (keys, month, ret): last value of a month over that of the month before; the
    first month has none."""
    month = level.groupBy(*keys, F.trunc("trade_date", "month").alias("month")).agg(F.max_by("nav", "trade_date").alias("nav"))
    w = (Window.partitionBy(*keys) if keys else Window.partitionBy()).orderBy("month")
    before = F.lag("nav").over(w)
    return month.select(*keys, "month", F.when(before > 0, F.col("nav") / before - 1).alias("ret")).where("ret is not null")


def holdings(targets: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """The names of each date, sorted; as many as a portfolio holds."""
    return targets.groupBy(*keys, "trade_date").agg(F.sort_array(F.collect_list("entity_code")).alias("holdings"))


# --- composition of several score engines ---


def _leading(batches):
    """Of each batch the rows that can be among the top_n of their engine and date."""
    for batch in batches:
        if not batch.num_rows:
            continue
        score = batch.column("score").cast(pa.float64())
        codes = [batch.column(k).dictionary_encode().indices.fill_null(-1) for k in ("engine", "trade_date")]
        table = pa.table([*codes, pc.is_nan(score), score, batch.column("entity_code")], ["e", "d", "nan", "score", "code"])
        order = pc.sort_indices(table, [("e", "ascending"), ("d", "ascending"), ("nan", "descending"), ("score", "descending"), ("code", "ascending")]).to_numpy()
        e, d = (c.to_numpy()[order] for c in codes)
        at = np.arange(len(order))
        first = np.maximum.accumulate(np.where(np.concatenate([[True], (e[1:] != e[:-1]) | (d[1:] != d[:-1])]), at, 0))
        kept = order[at - first < batch.column("top_n").to_numpy(zero_copy_only=False)[order]]
        yield batch.take(pa.array(np.sort(kept)))


def compose(predictions: DataFrame, engines: DataFrame) -> DataFrame:
    """predictions (trade_date, entity_code, engine, score), engines (engine, priority, weight, threshold, top_n).

    Per engine and date the names that reach its threshold, at most top_n, with their position from 1. What cannot be among
    them is left out batch by batch, so that few rows are shuffled and put in order.
    """
    met = predictions.join(F.broadcast(engines), "engine").where((F.col("score") >= F.col("threshold")) & F.col("top_n").isNotNull())
    met = met.mapInArrow(_leading, T.StructType([T.StructField(f.name, f.dataType, True) for f in met.schema.fields]))
    place = F.row_number().over(Window.partitionBy("engine", "trade_date").orderBy(F.col("score").desc(), "entity_code"))
    return met.withColumn("position", place).where(F.col("position") <= F.col("top_n"))


def gated(composed: DataFrame, gates: list[str], ranker: str) -> DataFrame:
    """Hierarchical composition: the ranker's names that every gate engine lets through."""
    out = composed.where(F.col("engine") == ranker)
    for g in gates:
        out = out.join(composed.where(F.col("engine") == g).select("trade_date", "entity_code"), ["trade_date", "entity_code"], "left_semi")
    return out


def merge_priority(composed: DataFrame) -> DataFrame:
    """Names in the order of engines, then positions; scores fall evenly from 1 to -1."""
    best = composed.groupBy("trade_date", "entity_code").agg(F.min(F.struct("priority", "position")).alias("o"))
    day = Window.partitionBy("trade_date")
    placed = best.withColumns({"place": F.row_number().over(day.orderBy("o", "entity_code")), "n": F.count(F.lit(1)).over(day)})
    return placed.select("trade_date", "entity_code", "place", F.when(F.col("n") > 1, 1 - 2 * (F.col("place") - 1) / (F.col("n") - 1)).otherwise(1.0).alias("score"))


def merge_weighted(composed: DataFrame, k: int) -> DataFrame:
    """Names that all k engines hold, by the weighted mean of their scores, within -1 and 1."""
    s = composed.groupBy("trade_date", "entity_code").agg(F.count_distinct("engine").alias("k"), (F.sum(F.col("weight") * F.col("score")) / F.sum("weight")).alias("score"))
    return s.where(F.col("k") == k).select("trade_date", "entity_code", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("score"))).alias("score"))


def merge_union(composed: DataFrame) -> DataFrame:
    """Names that any engine holds, by the weighted mean over the engines that do."""
    return composed.groupBy("trade_date", "entity_code").agg((F.sum(F.col("weight") * F.col("score")) / F.sum("weight")).alias("score"))


def expand_scopes(groups: DataFrame, members: DataFrame, scope: str) -> DataFrame:
    """Scores of groups (trade_date, group, engine, score) to the members (trade_date, entity_code, group) of the date."""
    return groups.join(members, ["trade_date", "group"]).select("trade_date", "entity_code", "engine", "score", F.lit(scope).alias("scope"))


def gate_audit(composed: DataFrame) -> DataFrame:
    """(engine, dates, mean, least, most): names that get through each stage."""
    n = composed.groupBy("engine", "trade_date").agg(F.count("*").alias("n"))
    return n.groupBy("engine").agg(F.count("*").alias("dates"), F.avg("n").alias("mean"), F.min("n").alias("least"), F.max("n").alias("most"))


def window_report(daily: DataFrame, windows: DataFrame) -> DataFrame:
    """Performance per window (window, start_date, end_date) of daily (trade_date, ret, excess), from 1 in each.

    Adds excess_annual, and complete: whether the first and the last date reach the window's ends. Windows are turned into
    their dates, so that the join is by equality.
    """
    days = windows.select("window", "start_date", "end_date", F.explode(F.sequence("start_date", "end_date")).alias("trade_date"))
    met = daily.join(days, "trade_date")
    excess = performance(met.select("window", "trade_date", F.col("excess").alias("ret")).where("ret is not null"), ("window",))
    span = met.groupBy("window").agg(((F.min("trade_date") <= F.first("start_date")) & (F.max("trade_date") >= F.first("end_date"))).cast("int").alias("complete"))
    own = performance(met.select("window", "trade_date", "ret"), ("window",))
    return own.join(excess.select("window", F.col("annual").alias("excess_annual")), "window", "left").join(span, "window")


def window_stability(report: DataFrame) -> DataFrame:
    """(complete_window_count, mean_excess, positive_window_ratio, excess_std, worst_window, failed, status) of the
    complete windows of a report. Fixed values: the bounds."""
    e = F.col("excess_annual")
    s = report.where("complete = 1").agg(
        F.count("*").alias("complete_window_count"), F.avg(e).alias("mean_excess"), F.avg((e > 0).cast("double")).alias("positive_window_ratio"),
        F.stddev_pop(e).alias("excess_std"), F.min(e).alias("worst_window"),
    )
    rules = {
        "complete_window_count": F.col("complete_window_count") >= 3,
        "mean_excess": F.col("mean_excess") > 0,
        "positive_window_ratio": F.col("positive_window_ratio") >= 2 / 3,
        "excess_std": F.col("excess_std") <= 0.10,
        "worst_window": F.col("worst_window") >= -0.05,
    }
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(holds, F.lit(False)), name) for name, holds in rules.items()]))
    status = F.when(F.col("mean_excess").isNull(), "insufficient").when(F.size("failed") == 0, "stable").otherwise("unstable")
    return s.withColumn("failed", failed).withColumn("status", status)


def aligned_windows(windows: DataFrame) -> DataFrame:
    """(engines, variants, aligned): whether all engines share their list of (start_date, end_date)."""
    lists = windows.groupBy("engine").agg(F.sort_array(F.collect_set(F.struct("start_date", "end_date"))).alias("w"))
    return lists.agg(F.count("*").alias("engines"), F.count_distinct("w").alias("variants")).withColumn("aligned", (F.col("variants") == 1).cast("int"))


#: The four profiles, from no gate to both.
PROFILES = ("stock_only", "style_stock", "industry_stock", "full")


def gate_attribution(windows: DataFrame) -> DataFrame:
    """windows (window, profile, annual, excess_annual) of the four profiles -> per window that all have: the benchmark's
    annual return and regime, the mean excess, whether all fall short, what each gate adds, their interaction, weakest.
    """
    bench = (F.col("annual") - F.col("excess_annual")).alias("bench")
    per = windows.withColumn("bench", bench).groupBy("window").pivot("profile", list(PROFILES)).agg(F.first("excess_annual").alias("excess"), F.first("bench").alias("bench"))
    e, b = ([F.col(f"{p}_{what}") for p in PROFILES] for what in ("excess", "bench"))
    stock, style, industry, full = e
    mean = lambda xs: F.try_divide(reduce(add, [F.coalesce(v, F.lit(0.0)) for v in xs]), reduce(add, [v.isNotNull().cast("int") for v in xs]))
    out = per.where(reduce(and_, [v.isNotNull() for v in e])).select(
        "window", mean(b).alias("bench_annual"), mean(e).alias("mean_excess"), (F.greatest(*e) < 0).cast("int").alias("all_negative"),
        (style - stock).alias("style_delta"), (industry - stock).alias("industry_delta"), (full - industry).alias("full_delta"), (full - industry - style + stock).alias("interaction"),
    )
    lowest = F.min(F.struct("mean_excess", "window")).over(Window.partitionBy())["window"]  # a row per window
    return out.withColumns({"regime": market_regime(F.col("bench_annual")), "weakest": (F.col("window") == lowest).cast("int")})


def order_snapshot(predictions: DataFrame, panel: DataFrame, current: DataFrame, before: str, n: int) -> DataFrame:
    """Targets of the last signal date before a day and current holdings, with that date's price and flags."""
    past = predictions.where(F.col("trade_date") < F.lit(before).cast("date"))
    last = past.agg(F.max("trade_date").alias("trade_date"))
    rows = past.join(last, "trade_date", "left_semi")
    top = rows.orderBy(F.col("score").desc(), "entity_code").limit(n).select("entity_code", "trade_date", F.lit(1).alias("target"))
    held = current.select("entity_code", F.lit(1).alias("held"))
    names = top.select("entity_code", "target").join(held, "entity_code", "full_outer").fillna(0, ["target", "held"])
    priced = trade_flags(panel.join(last, "trade_date", "left_semi")).select("entity_code", "close", "buy_allowed", "sell_allowed")
    return names.join(priced, "entity_code", "left")
