"""The factor catalogue: each factor is a composition of scalar and rolling functions over the panel's columns.

`factor(name)(panel)` adds the factor as `raw_value`; `columns(names)` gives many at once, which share one shuffle and
sort, as all use the same window. Nested factors, and
those of long frames that need two passes, come from `nested` (NESTED, MOMENTS). ROLLED has every flat factor in that form too.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import rolling as r
from . import scalar as s
from .lagged import Rows, Series, finite_lagged, with_lagged


def c(name: str) -> Column:
    return F.col(name)


def _ratio(a: Column, b: Column) -> Column:
    return s.div(a, F.nullif(b, F.lit(0.0)))


def limit_up() -> Column:
    return s.and_(s.gt(c("high_limited"), 0), s.ge(c("close"), c("high_limited")))


def fear(vol: int = 20, ret: int = 5, volume: int = 20, weights: tuple[float, float, float, float] = (0.35, 0.3, 0.2, 0.15), scale: float = 10) -> Column:
    """Volatility, downside volatility, loss and rise in volume, weighted."""
    down = F.pow(r.mean(F.pow(s.less(c("pct_chg"), 0), F.lit(2.0)), vol), F.lit(0.5))
    loss = s.greater(-100 * r.period_return(c("close"), ret), 0)
    rise = s.greater(_ratio(c("volume"), r.mean(c("volume"), volume)) - 1, 0)
    return weights[0] * r.std(c("pct_chg"), vol) + weights[1] * down + weights[2] * loss + weights[3] * scale * rise


SEED: dict[str, Callable[[], Column]] = {
    "mean_volume": lambda: r.mean(c("volume"), 20),
    "mean_amount": lambda: r.mean(c("amount"), 20),
    "mean_turnover_rate": lambda: r.mean(c("turnover_rate"), 20),
    "period_return": lambda: r.period_return(c("close"), 20),
    "limit_up_count": lambda: r.sum_(limit_up(), 20),
    "first_limit_up_window": lambda: r.first_true(limit_up(), 60),
    "stock_fear_proxy": fear,
}

STYLE: dict[str, Callable[[], Column]] = {
    "average_share_turnover_annual": lambda: s.log_(r.sum_(c("turnover_rate"), 252) / 12),
    "average_share_turnover_quarterly": lambda: s.log_(r.sum_(c("turnover_rate"), 63) / 3),
    "share_turnover_monthly": lambda: s.log_(r.sum_(c("turnover_rate"), 21)),
    "book_to_price_ratio": lambda: _ratio(F.lit(1.0), c("pb")),
    "earnings_to_price_ratio": lambda: _ratio(F.lit(1.0), c("pe")),
    "btop": lambda: _ratio(F.lit(1.0), c("pb")),
}


def _balance(up: tuple[str, str], down: tuple[str, str]) -> Column:
    """26-row sum of gains over that of losses, in percent."""
    gain = r.sum_(s.greater(c(up[0]) - c(up[1]), 0), 26)
    return _ratio(gain, r.sum_(s.greater(c(down[0]) - c(down[1]), 0), 26)) * 100


def ar() -> Column:
    return _balance(("high", "open"), ("open", "low"))


def br() -> Column:
    return _balance(("high", "pre_close"), ("pre_close", "low"))


def true_range() -> Column:
    return s.greater(s.greater(c("high") - c("low"), F.abs(c("high") - c("pre_close"))), F.abs(c("low") - c("pre_close")))


def volume_ratio() -> Column:
    part = lambda test: r.sum_(s.if_(test, c("volume"), 0), 26)
    even = 0.5 * part(s.eq(c("pct_chg"), 0))
    return _ratio(part(s.gt(c("pct_chg"), 0)) + even, part(s.lt(c("pct_chg"), 0)) + even)


def wvad_term() -> Column:
    return _ratio(c("close") - c("open"), c("high") - c("low")) * c("volume")


SENTIMENT: dict[str, Callable[[], Column]] = {
    "AR": ar,
    "BR": br,
    "ARBR": lambda: ar() - br(),
    **{f"ATR{n}": lambda n=n: r.mean(true_range(), n) for n in (6, 14)},
    **{f"DAVOL{n}": lambda n=n: _ratio(r.mean(c("turnover_rate"), n), r.mean(c("turnover_rate"), 120)) for n in (5, 10, 20)},
    "PSY": lambda: r.sum_(s.gt(c("pct_chg"), 0), 12) / 12 * 100,
    "turnover_volatility": lambda: r.std(c("turnover_rate"), 20),
    **{f"TVMA{n}": lambda n=n: r.mean(c("amount"), n) for n in (6, 20)},
    **{f"TVSTD{n}": lambda n=n: r.std(c("amount"), n) for n in (6, 20)},
    "VDIFF": lambda: r.ema(c("volume"), 12) - r.ema(c("volume"), 26),
    **{f"VOL{n}": lambda n=n: r.mean(c("turnover_rate"), n) for n in (5, 10, 20, 60, 120, 240)},
    "VOSC": lambda: _ratio(r.ema(c("volume"), 12) - r.ema(c("volume"), 26), r.ema(c("volume"), 12)) * 100,
    "VR": volume_ratio,
    **{f"VROC{n}": lambda n=n: r.period_return(c("volume"), n) * 100 for n in (6, 12)},
    **{f"VSTD{n}": lambda n=n: r.std(c("volume"), n) for n in (10, 20)},
    "WVAD": lambda: r.sum_(wvad_term(), 6),
}

DAILY = lambda: c("pct_chg") / 100

RISK: dict[str, Callable[[], Column]] = {
    **{f"Kurtosis{n}": lambda n=n: r.kurt(DAILY(), n) for n in (20, 60, 120)},
    **{f"Skewness{n}": lambda n=n: r.skew(DAILY(), n) for n in (20, 60, 120)},
    **{f"Variance{n}": lambda n=n: r.var(DAILY(), n) for n in (20, 60, 120)},
    **{f"sharpe_ratio_{n}": lambda n=n: _ratio(r.mean(DAILY(), n) * 252 - 0.04, r.std(DAILY(), n) * 252**0.5) for n in (20, 60, 120)},
}

TECHNICAL: dict[str, Callable[[], Column]] = {
    "boll_up": lambda: _ratio(r.mean(c("close"), 20) + 2 * r.std(c("close"), 20), c("close")),
    "boll_down": lambda: _ratio(r.mean(c("close"), 20) - 2 * r.std(c("close"), 20), c("close")),
    "EMA5": lambda: _ratio(r.ema(c("close"), 5), c("close")),
    **{f"EMAC{n}": lambda n=n: _ratio(r.ema(c("close"), n), c("close")) for n in (10, 12, 20, 26, 120)},
    **{f"MAC{n}": lambda n=n: _ratio(r.mean(c("close"), n), c("close")) for n in (5, 10, 20, 60, 120)},
}


def typical() -> Column:
    return (c("high") + c("low") + c("close")) / 3


def cci(n: int) -> Column:
    return _ratio(typical() - r.mean(typical(), n), 0.015 * r.mad(typical(), n))


MOMENTUM: dict[str, Callable[[], Column]] = {
    "arron_up_25": lambda: r.idx_max(c("high"), 25) / 25 * 100,
    "arron_down_25": lambda: r.idx_min(c("low"), 25) / 25 * 100,
    "BBIC": lambda: _ratio(sum((r.mean(c("close"), n) for n in (6, 12, 24)), r.mean(c("close"), 3)) / 4, c("close")),
    **{f"BIAS{n}": lambda n=n: _ratio(c("close") - r.mean(c("close"), n), r.mean(c("close"), n)) * 100 for n in (5, 10, 20, 60)},
    "bull_power": lambda: _ratio(c("high") - r.ema(c("close"), 13), c("close")),
    "bear_power": lambda: _ratio(c("low") - r.ema(c("close"), 13), c("close")),
    **{f"CCI{n}": lambda n=n: cci(n) for n in (10, 15, 20)},
    **{f"PLRC{n}": lambda n=n: _ratio(r.slope(c("close"), n), r.mean(c("close"), n)) for n in (6, 12, 24)},
    **{f"Price{k}": lambda n=n: _ratio(c("close"), r.mean(c("close"), n)) - 1 for k, n in (("1M", 21), ("3M", 61), ("1Y", 250))},
    **{f"ROC{n}": lambda n=n: r.period_return(c("close"), n) * 100 for n in (6, 12, 20)},
    "single_day_VPT": lambda: DAILY() * c("volume"),
    **{f"single_day_VPT_{n}": lambda n=n: r.mean(DAILY() * c("volume"), n) for n in (6, 12)},
    "Volume1M": lambda: _ratio(c("volume"), r.mean(c("volume"), 20)) * r.mean(DAILY(), 20),
}

AMBIGUOUS: dict[str, Callable[[], Column]] = {
    "money_flow_20": lambda: r.mean(typical() * c("volume"), 20),
    **{f"VEMA{n}": lambda n=n: r.ema(c("volume"), n) for n in (5, 10, 12, 26)},
    "price_no_fq": lambda: c("close"),
    "fifty_two_week_close_rank": lambda: 1 - r.ts_rank(c("close"), 250),
    **{f"ROC{n}": lambda n=n: r.period_return(c("close"), n) * 100 for n in (60, 120)},
}

GROUPS = {"seed": SEED, "style": STYLE, "sentiment": SENTIMENT, "risk": RISK, "technical": TECHNICAL, "momentum": MOMENTUM, "ambiguous": AMBIGUOUS}
FLAT = {name: make for group in GROUPS.values() for name, make in group.items()}


def _macd(p: Rows, x: str) -> tuple[Series, Series]:
    dif = p.ema(p[x], 12) - p.ema(p[x], 26)
    return dif, p.ema(dif, 9)


def _macdc(p: Rows) -> Series:
    dif, dea = _macd(p, "close")
    return 2 * (dif - dea) / p["close"]


def _vmacd(p: Rows) -> Series:
    dif, dea = _macd(p, "volume")
    return 2 * (dif - dea)


def _trix(p: Rows, n: int) -> Series:
    return p.period_return(p.ema(p.ema(p.ema(p["close"], n), n), n), 1) * 100


def _typical(p: Rows) -> Series:
    return (p["high"] + p["low"] + p["close"]) / 3


def _mfi(p: Rows) -> Series:
    price = _typical(p)
    move, flow = price - p.ref(price, 1), price * p["volume"]
    part = lambda on: p.sum(Series(np.where(on & move.ok, flow.v, 0.0), np.where(on & move.ok, flow.ok, True)), 14)
    ratio = 1 + part(move.v > 0) / part(move.v < 0)
    return 100 - (0 * ratio + 100) / ratio


def _cr(p: Rows) -> Series:
    mid = p.ref((p["high"] + p["low"]) / 2, 1)
    return p.sum((p["high"] - mid).at_least(0), 20) / p.sum((mid - p["low"]).at_least(0), 20) * 100


def _mass(p: Rows) -> Series:
    e = p.ema(p["high"] - p["low"], 9)
    return p.sum(e / p.ema(e, 9), 25)


def _mawvad(p: Rows) -> Series:
    return p.mean(p.sum((p["close"] - p["open"]) / (p["high"] - p["low"]) * p["volume"], 6), 6)


def _cci88(p: Rows) -> Series:
    price = _typical(p)
    return (price - p.mean(price, 88)) / (0.015 * p.mad(price, 88))


def _daily(p: Rows) -> Series:
    return p["pct_chg"] / 100


def _log_return(p: Rows) -> Series:
    return (1 + _daily(p)).log()


def _half_life_std(p: Rows) -> Series:
    m = p.half_life(_daily(p), 252, 42)
    return (p.half_life(_daily(p) * _daily(p), 252, 42) - m * m).at_least(0).sqrt()


def _cumulative_range(p: Rows, months: int = 12) -> Series:
    """Largest minus smallest cumulative log return over the last 12 months of 21 rows."""
    z = [(p["close"] / p.ref(p["close"], 21 * k)).log() for k in range(1, months + 1)]
    most, least = (pick([np.where(x.ok, x.v, end) for x in z], axis=0) for pick, end in ((np.max, -np.inf), (np.min, np.inf)))
    return Series(most - least, np.any([x.ok for x in z], axis=0))


def _rank_1m(df: DataFrame) -> DataFrame:
    """The share of entities with a larger 20-row return on the day, from that return."""
    day = Window.partitionBy("trade_date")
    place = F.rank().over(day.orderBy(c("Rank1M").desc_nulls_last()))
    return df.withColumn("Rank1M", F.when(c("Rank1M").isNotNull(), s.div(place, F.count("Rank1M").over(day))))


#: Nested factors by what they take of an entity's rows. Rank1M is put into its cross-section after that.
NESTED: dict[str, Callable[[Rows], Series]] = {
    "MACDC": _macdc,
    "VDEA": lambda p: _macd(p, "volume")[1],
    "VMACD": _vmacd,
    "MAWVAD": _mawvad,
    "TRIX5": lambda p: _trix(p, 5),
    "TRIX10": lambda p: _trix(p, 10),
    "MASS": _mass,
    "CR20": _cr,
    "MFI14": _mfi,
    "CCI88": _cci88,
    "Rank1M": lambda p: p.period_return(p["close"], 20),
    "daily_standard_deviation": _half_life_std,
    "momentum": lambda p: p.half_life(p.ref(_log_return(p), 21), 504, 126),
    "relative_strength": lambda p: p.half_life(_log_return(p), 504, 126),
    "cumulative_range": _cumulative_range,
}

#: Flat factors that cost less this way than as sliding frames; the results are those of FLAT.
MOMENTS: dict[str, Callable[[Rows], Series]] = {f"{name}{n}": lambda p, n=n, k=k: p.moment(p.once("daily", _daily), n, k) for name, k in (("Kurtosis", 4), ("Skewness", 3)) for n in (20, 60, 120)}


def _flags(on: np.ndarray) -> Series:
    return Series(on.astype(float), np.ones(len(on), bool))


def _at_limit(p: Rows) -> Series:
    """1 or 0, never null."""
    limit, close = p["high_limited"], p["close"]
    return _flags(limit.ok & close.ok & (limit.v > 0) & (close.v >= limit.v))


def _first_at_limit(p: Rows) -> Series:
    now = p.once("at_limit", _at_limit)
    before = p.sum(p.ref(now, 1), 59)
    return _flags((now.v == 1) & ~(before.ok & (before.v > 0)))


def _fear(p: Rows) -> Series:
    low = p["pct_chg"].at_most(0)
    down = p.mean(low * low, 20).sqrt()
    loss = (-100 * p.period_return(p["close"], 5)).at_least(0)
    rise = (p["volume"] / p.mean(p["volume"], 20) - 1).at_least(0)
    return 0.35 * p.std(p["pct_chg"], 20) + 0.3 * down + 0.2 * loss + 0.15 * 10 * rise


def _gain(p: Rows, up: str, down: str) -> Series:
    return p.sum((p[up] - p[down]).at_least(0), 26)


def _ar(p: Rows) -> Series:
    return _gain(p, "high", "open") / _gain(p, "open", "low") * 100


def _br(p: Rows) -> Series:
    return _gain(p, "high", "pre_close") / _gain(p, "pre_close", "low") * 100


def _true_range(p: Rows) -> Series:
    return (p["high"] - p["low"]).at_least(abs(p["high"] - p["pre_close"])).at_least(abs(p["low"] - p["pre_close"]))


def _volume_ratio(p: Rows) -> Series:
    move, volume = p["pct_chg"], p["volume"]
    part = lambda on: p.sum(Series(np.where(on & move.ok, volume.v, 0.0), np.where(on & move.ok, volume.ok, True)), 26)
    even = 0.5 * part(move.v == 0)
    return (part(move.v > 0) + even) / (part(move.v < 0) + even)


def _wvad(p: Rows) -> Series:
    return (p["close"] - p["open"]) / (p["high"] - p["low"]) * p["volume"]


def _volume_move(p: Rows) -> Series:
    return p.once("daily", _daily) * p["volume"]


def _mean_of(x: str, n: int) -> Callable[[Rows], Series]:
    return lambda p: p.mean(p[x], n)


def _std_of(x: str, n: int) -> Callable[[Rows], Series]:
    return lambda p: p.std(p[x], n)


def _sharpe(p: Rows, n: int) -> Series:
    d = p.once("daily", _daily)
    return (p.mean(d, n) * 252 - 0.04) / (p.std(d, n) * 252**0.5)


def _cci(p: Rows, n: int) -> Series:
    price = p.once("typical", _typical)
    return (price - p.mean(price, n)) / (0.015 * p.mad(price, n))


def _share_turnover(p: Rows, n: int, months: int) -> Series:
    return (p.sum(p["turnover_rate"], n) / months).log()


def _vosc(p: Rows) -> Series:
    short = p.once("volume_ema12", lambda p: p.ema(p["volume"], 12))
    return (short - p.once("volume_ema26", lambda p: p.ema(p["volume"], 26))) / short * 100


def _period(x: str, n: int) -> Callable[[Rows], Series]:
    return lambda p: p.period_return(p[x], n) * 100


#: Every factor of FLAT once more, over the rows of a pass: the same values, for jobs that take many of them at once.
ROLLED: dict[str, Callable[[Rows], Series]] = {
    "mean_volume": _mean_of("volume", 20), "mean_amount": _mean_of("amount", 20), "mean_turnover_rate": _mean_of("turnover_rate", 20),
    "period_return": lambda p: p.period_return(p["close"], 20),
    "limit_up_count": lambda p: p.sum(p.once("at_limit", _at_limit), 20),
    "first_limit_up_window": _first_at_limit,
    "stock_fear_proxy": _fear,
    **{n: lambda p, k=k, m=m: _share_turnover(p, k, m) for n, k, m in (("average_share_turnover_annual", 252, 12), ("average_share_turnover_quarterly", 63, 3), ("share_turnover_monthly", 21, 1))},
    **{n: lambda p, x=x: 1 / p[x] for n, x in (("book_to_price_ratio", "pb"), ("earnings_to_price_ratio", "pe"), ("btop", "pb"))},
    "AR": lambda p: p.once("ar", _ar), "BR": lambda p: p.once("br", _br), "ARBR": lambda p: p.once("ar", _ar) - p.once("br", _br),
    **{f"ATR{n}": lambda p, n=n: p.mean(p.once("true_range", _true_range), n) for n in (6, 14)},
    **{f"DAVOL{n}": lambda p, n=n: p.mean(p["turnover_rate"], n) / p.mean(p["turnover_rate"], 120) for n in (5, 10, 20)},
    "PSY": lambda p: p.sum(Series((p["pct_chg"].v > 0).astype(float), p["pct_chg"].ok), 12) / 12 * 100,
    "turnover_volatility": _std_of("turnover_rate", 20),
    **{f"TVMA{n}": _mean_of("amount", n) for n in (6, 20)}, **{f"TVSTD{n}": _std_of("amount", n) for n in (6, 20)},
    "VDIFF": lambda p: p.once("volume_ema12", lambda p: p.ema(p["volume"], 12)) - p.once("volume_ema26", lambda p: p.ema(p["volume"], 26)),
    **{f"VOL{n}": _mean_of("turnover_rate", n) for n in (5, 10, 20, 60, 120, 240)},
    "VOSC": _vosc, "VR": _volume_ratio,
    **{f"VROC{n}": _period("volume", n) for n in (6, 12)}, **{f"VSTD{n}": _std_of("volume", n) for n in (10, 20)},
    "WVAD": lambda p: p.sum(p.once("wvad", _wvad), 6),
    **MOMENTS,
    **{f"Variance{n}": lambda p, n=n: p.var(p.once("daily", _daily), n) for n in (20, 60, 120)},
    **{f"sharpe_ratio_{n}": lambda p, n=n: _sharpe(p, n) for n in (20, 60, 120)},
    "boll_up": lambda p: (p.mean(p["close"], 20) + 2 * p.std(p["close"], 20)) / p["close"],
    "boll_down": lambda p: (p.mean(p["close"], 20) - 2 * p.std(p["close"], 20)) / p["close"],
    **{name: lambda p, n=n: p.ema(p["close"], n) / p["close"] for name, n in (("EMA5", 5), *((f"EMAC{n}", n) for n in (10, 12, 20, 26, 120)))},
    **{f"MAC{n}": lambda p, n=n: p.mean(p["close"], n) / p["close"] for n in (5, 10, 20, 60, 120)},
    "arron_up_25": lambda p: p.place_of_most(p["high"], 25) / 25 * 100,
    "arron_down_25": lambda p: p.place_of_most(-1 * p["low"], 25) / 25 * 100,
    "BBIC": lambda p: (p.mean(p["close"], 3) + p.mean(p["close"], 6) + p.mean(p["close"], 12) + p.mean(p["close"], 24)) / 4 / p["close"],
    **{f"BIAS{n}": lambda p, n=n: (p["close"] - p.mean(p["close"], n)) / p.mean(p["close"], n) * 100 for n in (5, 10, 20, 60)},
    **{f"{n}_power": lambda p, x=x: (p[x] - p.once("close_ema13", lambda p: p.ema(p["close"], 13))) / p["close"] for n, x in (("bull", "high"), ("bear", "low"))},
    **{f"CCI{n}": lambda p, n=n: _cci(p, n) for n in (10, 15, 20)},
    **{f"PLRC{n}": lambda p, n=n: p.slope(p["close"], n) / p.mean(p["close"], n) for n in (6, 12, 24)},
    **{f"Price{k}": lambda p, n=n: p["close"] / p.mean(p["close"], n) - 1 for k, n in (("1M", 21), ("3M", 61), ("1Y", 250))},
    **{f"ROC{n}": _period("close", n) for n in (6, 12, 20, 60, 120)},
    "single_day_VPT": _volume_move, **{f"single_day_VPT_{n}": lambda p, n=n: p.mean(p.once("volume_move", _volume_move), n) for n in (6, 12)},
    "Volume1M": lambda p: p["volume"] / p.mean(p["volume"], 20) * p.mean(p.once("daily", _daily), 20),
    "money_flow_20": lambda p: p.mean(p.once("typical", _typical) * p["volume"], 20),
    **{f"VEMA{n}": lambda p, n=n: p.ema(p["volume"], n) for n in (5, 10, 12, 26)},
    "price_no_fq": lambda p: p["close"],
    "fifty_two_week_close_rank": lambda p: 1 - p.share_at_most(p["close"], 250),
}

#: The columns of a panel that factors take.
FIELDS = ("open", "high", "low", "close", "pre_close", "high_limited", "volume", "amount", "pct_chg", "turnover_rate", "pe", "pb")

#: Rows that the longest chain of frames above looks back (momentum: 21 and 503).
BACK = 524


def columns(names: list[str]) -> dict[str, Column]:
    return {n: FLAT[n]().cast("double") for n in names}


def factor(name: str) -> Callable[[DataFrame], DataFrame]:
    """A function from a panel to the panel with raw_value."""
    if name in NESTED:
        return lambda panel: nested(panel, [name]).withColumnRenamed(name, "raw_value")
    return lambda panel: r.with_row_index(panel).withColumn("raw_value", FLAT[name]().cast("double")).drop("row_index")


def nested(panel: DataFrame, names: list[str] | None = None) -> DataFrame:
    """panel with a column per nested factor or entry of ROLLED; all but the cross-section in one pass over the entities."""
    names = list(NESTED) if names is None else names
    wide = with_lagged(panel, {n: (NESTED | ROLLED)[n] for n in names}, BACK)
    return _rank_1m(wide) if "Rank1M" in names else wide


def finite_counts(panel: DataFrame, names: list[str]) -> DataFrame:
    """One row: __rows, and per factor how many of its values are finite. All come from one pass over the entities; a row
    that leaves it holds what the cross-section needs, and nothing of factors that are only counted."""
    fields = [f for f in FIELDS if f in panel.columns]
    across = [n for n in names if n == "Rank1M"]
    rows = finite_lagged(panel.select("entity_code", "trade_date", *fields), {n: (NESTED | ROLLED)[n] for n in names}, BACK, across)
    ready = _rank_1m(rows) if across else rows
    whole = lambda n: F.count(F.when(c(n).isNotNull() & ~F.isnan(n) & (F.abs(c(n)) < float("inf")), 1))
    return ready.agg(F.count("*").alias("__rows"), *[(whole(n) if n in across else F.coalesce(F.sum(c("finite")[i]), F.lit(0))).alias(n) for i, n in enumerate(names)])
