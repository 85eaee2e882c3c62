"""Daily selection by scores: market and industry signals, filters, presets, and what very low scores say."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import CAP_NAMES, SCORE_BANDS, board_name, cap_bucket, is_growth_board, is_main_board, market_state, position_advice, score_band
from . import cross_section as x


@dataclass(frozen=True)
class Strategy:
    """entry, strong: the market is entered if the leading industries' mean best score and the number of strong
    industries reach them. low, high: the range of scores, both ends included. limit_move: in percent. most: names a day.
    """

    entry: float = 0.09
    strong: int = 2
    low: float = 0.10
    high: float = 0.12
    limit_move: float = 9.8
    most: int = 5
    main_board_only: bool = True
    exclude_st: bool = True
    index_filter: bool = True


#: The presets.
PRESETS = {
    "balanced": Strategy(),
    "conservative": replace(Strategy(), entry=0.10, strong=5),
    "aggressive": replace(Strategy(), entry=0.07, strong=1),
}
#: The best score from which an industry is strong, and the score below which a name is negative.
STRONG, NEGATIVE = 0.10, -0.06


def industry_signals(df: DataFrame, n: int = 20, strong: float = STRONG) -> DataFrame:
    """df (trade_date, entity_code, industry, score) -> per date: industries at or over `strong`, and the mean best score
    of the industries that the n best names come from."""
    best = df.groupBy("trade_date", "industry").agg(F.max("score").alias("best"))
    top = df.withColumn("__r", x.rank_first("score")).where(F.col("__r") <= n).select("trade_date", "industry").distinct()
    mean = best.join(top, ["trade_date", "industry"]).groupBy("trade_date").agg(F.avg("best").alias("mean_best"), F.count("*").alias("top_industries"))
    return best.groupBy("trade_date").agg(F.count(F.when(F.col("best") >= strong, 1)).alias("strong")).join(mean, "trade_date")


def top_by_industry(df: DataFrame) -> DataFrame:
    """The best name of each industry and date, ties by code."""
    own = Window.partitionBy("trade_date", "industry").orderBy(F.col("score").desc(), "entity_code")
    return df.withColumn("__r", F.row_number().over(own)).where("__r = 1").drop("__r")


def above_ma(index: DataFrame, n: int = 20) -> DataFrame:
    """index (trade_date, close) with above: whether it is not under its mean of n rows; true while there are fewer."""
    w = Window.orderBy("trade_date").rowsBetween(-(n - 1), 0)
    return index.withColumn("above", ((F.count("close").over(w) < n) | (F.col("close") >= F.avg("close").over(w))).cast("int"))


def market_gate(signals: DataFrame, index: DataFrame, strategy: Strategy = Strategy()) -> DataFrame:
    """signals of industry_signals, index (trade_date, above) -> with state, position, and enter: whether to buy that day.

    A date without an index value counts as above its mean.
    """
    met = signals.join(index.select("trade_date", "above"), "trade_date", "left")
    above = F.coalesce(F.col("above"), F.lit(1)) == 1 if strategy.index_filter else F.lit(True)
    enter = (F.col("mean_best") >= strategy.entry) & (F.col("strong") >= strategy.strong) & above
    return met.select("trade_date", "strong", "mean_best", market_state(F.col("mean_best")).alias("state"), position_advice(F.col("mean_best"), F.col("strong")).alias("position"), enter.cast("int").alias("enter"))


def trend(df: DataFrame, ahead: bool = True) -> DataFrame:
    """df (entity_code, trade_date, score) with trend, the score against the previous one and the next, and buyable.

    The next score is one of a later date: without `ahead`, as on the last date, only the previous one counts.
    """
    w = Window.partitionBy("entity_code").orderBy("trade_date")
    now, before = F.col("score"), F.lag("score").over(w)
    after = F.lead("score").over(w) if ahead else F.lit(None).cast("double")
    both, up = before.isNotNull() & after.isNotNull(), before < now
    name = (
        F.when(now.isNull(), "无今日分数")
        .when(both & up & (after < now), "先升后降")
        .when(both & up, "连续上升")
        .when(both & (after < now), "回落中")
        .when(both, "连续下降")
        .when(before.isNotNull(), F.when(up, "上升中").otherwise("回落中"))
        .when(after.isNotNull(), F.when(after < now, "明日回落").otherwise("连续上升"))
        .otherwise("趋势未知")
    )
    out = df.withColumn("trend", name)
    return out.withColumn("buyable", (~F.col("trend").isin("无今日分数", "连续上升", "连续下降")).cast("int"))


def daily_selection(df: DataFrame, gate: DataFrame, strategy: Strategy = Strategy()) -> DataFrame:
    """df (trade_date, entity_code, score, industry, pct_chg, is_st, buyable) -> the best names of each date that is entered.

    Names must score within the range, be on the board, have an industry and be buyable, not be ST, and not have moved to
    the limit; flags that are unknown let them pass.
    """
    code = F.col("entity_code")
    ok = F.col("score").between(strategy.low, strategy.high) & (is_growth_board(code) == 0) & (F.col("industry") != "") & (F.col("buyable") == 1)
    if strategy.main_board_only:
        ok &= is_main_board(code) == 1
    if strategy.exclude_st:
        ok &= F.coalesce(F.col("is_st"), F.lit(0)) != 1
    ok &= F.coalesce(F.abs("pct_chg"), F.lit(0.0)) < strategy.limit_move
    entered = gate.where("enter = 1").select("trade_date")
    return df.where(ok).join(entered, "trade_date", "left_semi").withColumn("place", x.rank_first("score")).where(F.col("place") <= strategy.most)


def negative_selection(df: DataFrame) -> DataFrame:
    """df (trade_date, entity_code, score, cap) -> negative scores with cap_band, board, short and missed.

    short: low scores of small names fall on, those of large ones only far down. missed: bands in which they came back.
    Fixed values: the bands.
    """
    low = df.where(F.col("score") < NEGATIVE).withColumns({"cap_band": cap_bucket(F.col("cap")), "board": board_name(F.col("entity_code")), "band": score_band(F.col("score"))})
    score, cap = F.col("score"), F.col("cap_band")
    large = cap.isin("大盘", "超大盘")
    missed = ((cap == "超大盘") & score.between(-0.14, -0.13)) | ((cap == "大盘") & score.between(-0.115, -0.105)) | ((F.col("board") == "科创板") & (score >= -0.15))
    return low.withColumns({"short": (~large | (score <= -0.22)).cast("int"), "missed": missed.cast("int")})


def negative_matrix(low: DataFrame) -> DataFrame:
    """low of negative_selection -> (trade_date, band, a column for each band of market value): the full grid of counts."""
    days = low.select("trade_date").distinct()
    grid = days.select("trade_date", F.explode(F.array(*map(F.lit, SCORE_BANDS))).alias("band"))
    counts = low.groupBy("trade_date", "band").pivot("cap_band", list(CAP_NAMES)).agg(F.count(F.lit(1)))
    return grid.join(counts, ["trade_date", "band"], "left").fillna(0)


def industry_rotation(picks: DataFrame, gate: DataFrame, n: int = 5) -> DataFrame:
    """picks (trade_date, industry) -> the n industries with most picks per month; days of a weak market do not count."""
    weak = gate.where(F.col("state").isin("熊市", "震荡偏弱")).select("trade_date")
    s = picks.join(weak, "trade_date", "left_anti").groupBy(F.trunc("trade_date", "month").alias("month"), "industry").agg(F.count("*").alias("picks"))
    return s.withColumn("place", F.row_number().over(Window.partitionBy("month").orderBy(F.col("picks").desc(), "industry"))).where(F.col("place") <= n)


def trade_stats(trades: DataFrame) -> DataFrame:
    """trades (ret) of sales -> trades, win_rate, gain (mean of gains), loss (mean of the rest); 0 where there are none."""
    ret = F.col("ret")
    s = trades.agg(F.count("ret").alias("trades"), F.avg((ret > 0).cast("double")).alias("win_rate"), F.avg(F.when(ret > 0, ret)).alias("gain"), F.avg(F.when(ret <= 0, ret)).alias("loss"))
    return s.fillna(0.0)


def nav_stats(level: DataFrame) -> DataFrame:
    """level (trade_date, nav) from 1 -> days, total, annual, drawdown (a share of the peak), return over drawdown."""
    up = Window.orderBy("trade_date").rowsBetween(Window.unboundedPreceding, 0)  # a row per session
    fall = level.withColumn("fall", F.try_divide(F.max("nav").over(up) - F.col("nav"), F.max("nav").over(up)))
    s = fall.agg(F.count("*").alias("days"), (F.max_by("nav", "trade_date") - 1).alias("total"), F.max("fall").alias("drawdown"))
    annual = F.when(F.col("total") > -1, F.pow(1 + F.col("total"), 252 / F.col("days")) - 1).otherwise(-1.0)
    return s.withColumns({"annual": annual, "ratio": F.when(F.col("drawdown") > 0, F.col("total") / F.col("drawdown")).otherwise(0.0)})


def list_predictions(df: DataFrame, entity: str | None = None, limit: int = 100) -> DataFrame:
    """The latest date's predictions by score, or all dates of one entity."""
    if entity is not None:
        return df.where(F.col("entity_code") == entity).orderBy("trade_date").limit(limit)
    last = df.agg(F.max("trade_date").alias("trade_date"))
    return df.join(last, "trade_date", "left_semi").orderBy(F.col("score").desc(), "entity_code").limit(limit)
