"""Scalar formula functions: Column in, Column out, all inside code generation.

Null in, null out, unless a function says otherwise. Division by zero and logarithms of what is not positive give null,
as values that are not finite are dropped later anyway.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_ as both
from operator import or_ as either

from pyspark.sql import Column
from pyspark.sql import functions as F

Value = Column | float | int


def col(x: Value) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def add(a: Value, b: Value) -> Column:
    return col(a) + col(b)


def sub(a: Value, b: Value) -> Column:
    return col(a) - col(b)


def mul(a: Value, b: Value) -> Column:
    return col(a) * col(b)


def neg(a: Value) -> Column:
    return -col(a)


def div(a: Value, b: Value) -> Column:
    return F.try_divide(col(a), col(b))


def greater(a: Value, b: Value) -> Column:
    """The larger of two, null if either is."""
    return F.when(col(a).isNotNull() & col(b).isNotNull(), F.greatest(col(a), col(b)))


def less(a: Value, b: Value) -> Column:
    return F.when(col(a).isNotNull() & col(b).isNotNull(), F.least(col(a), col(b)))


def abs_(a: Value) -> Column:
    return F.abs(col(a))


def sign(a: Value) -> Column:
    return F.signum(col(a))


def log_(a: Value) -> Column:
    return F.when(col(a) > 0, F.log(col(a)))


def power(a: Value, b: Value) -> Column:
    return F.pow(col(a), col(b))


def null_if(a: Value, b: Value) -> Column:
    return F.nullif(col(a), col(b))


def is_null(a: Value) -> Column:
    return col(a).isNull().cast("int")


def fill_na(a: Value, b: Value) -> Column:
    return F.coalesce(col(a), col(b))


def truth(a: Value) -> Column:
    """1 for what is not zero, 0 for zero and null."""
    return F.coalesce((col(a) != 0).cast("int"), F.lit(0))


def if_(condition: Value, a: Value, b: Value) -> Column:
    return F.when(truth(condition) == 1, col(a)).otherwise(col(b))


def gt(a: Value, b: Value) -> Column:
    return (col(a) > col(b)).cast("int")


def ge(a: Value, b: Value) -> Column:
    return (col(a) >= col(b)).cast("int")


def lt(a: Value, b: Value) -> Column:
    return (col(a) < col(b)).cast("int")


def le(a: Value, b: Value) -> Column:
    return (col(a) <= col(b)).cast("int")


def eq(a: Value, b: Value) -> Column:
    return (col(a) == col(b)).cast("int")


def ne(a: Value, b: Value) -> Column:
    return (col(a) != col(b)).cast("int")


def and_(*conditions: Value) -> Column:
    return reduce(both, [truth(c) == 1 for c in conditions]).cast("int")


def or_(*conditions: Value) -> Column:
    return reduce(either, [truth(c) == 1 for c in conditions]).cast("int")


def not_(condition: Value) -> Column:
    return 1 - truth(condition)


def board(code: Column) -> Column:
    """The board that a code such as 600000.SH is listed on: fixed values by exchange suffix and number prefix."""
    number, exchange = F.substring_index(code, ".", 1), F.upper(F.substring_index(code, ".", -1))
    return (
        F.when(exchange == "BJ", "Beijing")
        .when((exchange == "SH") & (number.startswith("688") | number.startswith("689")), "STAR")
        .when((exchange == "SZ") & (number.startswith("300") | number.startswith("301")), "ChiNext")
        .when(exchange.isin("SH", "SZ"), "Main")
        .otherwise("Other")
    )


def _begins(code: Column, prefixes: tuple[str, ...]) -> Column:
    number = F.substring_index(code, ".", 1)
    return reduce(either, [number.startswith(p) for p in prefixes])


def is_main_board(code: Column) -> Column:
    """1 if the number is one of the main board's, whatever the exchange."""
    return _begins(code, MAIN_PREFIXES).cast("int")


def is_growth_board(code: Column) -> Column:
    return _begins(code, GROWTH_PREFIXES).cast("int")


def board_name(code: Column) -> Column:
    """The board by the number's prefix; numbers of the third board have six digits."""
    out = F.when(code.isNull(), None)
    for name, prefixes in BOARD_NAMES:
        fits = _begins(code, prefixes)
        out = out.when(fits & (F.length(F.substring_index(code, ".", 1)) == 6) if name == "北交所" else fits, name)
    return out.otherwise(BOARD_OTHER)


def bands(x: Column, edges: Sequence[float], names: Sequence[str]) -> Column:
    """names[i] for edges[i - 1] <= x < edges[i]; null for null."""
    out = F.when(x.isNull(), None)
    for edge, name in zip(edges, names, strict=False):
        out = out.when(x < edge, name)
    return out.otherwise(names[-1])


def cap_bucket(x: Column) -> Column:
    """The band of a market value; null is a band of its own."""
    return F.coalesce(bands(x, CAP_EDGES, CAP_NAMES), F.lit(CAP_UNKNOWN))


#: Edges and names of the bands of scores, markets and market value, and the prefixes of boards.
SCORE_EDGES = (-0.25, -0.20, -0.15, -0.10, -0.06)
SCORE_BANDS = ("≤-0.25", "-0.25~-0.20", "-0.20~-0.15", "-0.15~-0.10", "-0.10~-0.06")
MARKET_EDGES = (0.06, 0.09, 0.10, 0.12)
MARKET_STATES = ("熊市", "震荡偏弱", "震荡", "震荡偏强", "牛市")
CAP_EDGES = (3e9, 1e10, 3e10, 1e11)
CAP_NAMES = ("微盘", "小盘", "中盘", "大盘", "超大盘")
CAP_UNKNOWN = "未知"
MAIN_PREFIXES = ("600", "601", "603", "605", "000", "001", "002")
GROWTH_PREFIXES = ("688", "300", "301")
BOARD_NAMES = (("科创板", ("688",)), ("创业板", ("300", "301")), ("北交所", ("43", "83", "87", "88", "92")), ("沪深主板", (*MAIN_PREFIXES, "003")))
BOARD_OTHER = "其他"


def score_band(x: Column) -> Column:
    """The band of a low score, closed above; null for null and for what lies above the last edge."""
    out = F.when(x.isNull(), None)
    for edge, name in zip(SCORE_EDGES, SCORE_BANDS, strict=True):
        out = out.when(x <= edge, name)
    return out


def market_state(x: Column) -> Column:
    """The market by the mean best score of the leading industries."""
    return bands(x, MARKET_EDGES, MARKET_STATES)


def market_regime(x: Column) -> Column:
    """The market by a benchmark's annual return. Fixed values: -0.10, 0.05, 0.20."""
    return F.when(x.isNull(), "unknown").when(x >= 0.20, "strong_bull").when(x >= 0.05, "bull").when(x <= -0.10, "bear").otherwise("sideways")


def position_advice(x: Column, strong: Column) -> Column:
    """How much to hold, by the mean best score and the number of strong industries. Fixed values."""
    out = F.when(x.isNull(), None)
    for least, industries, share in ((0.12, 5, "100%"), (0.10, 3, "50%"), (0.09, 2, "30%")):
        out = out.when((x >= least) & (strong >= industries), share)
    return out.when(x >= 0.06, "0-30%").otherwise("0%")


def signal_close(day: Column) -> Column:
    """When a day's values can be known: 15:00 of that day."""
    return day.cast("timestamp") + F.expr("INTERVAL 15 HOURS")


def source_start(day: Column, window: int) -> Column:
    """How far back to read for a window of n rows, in calendar days."""
    return F.date_sub(day, max(4 * window + 20, 90))


def preset_start(day: Column, preset: str) -> Column:
    """Months of the presets."""
    return F.add_months(day, -{"3m": 3, "1y": 12, "3y": 36, "10y": 120}[preset])


def payload(**columns: Column) -> Column:
    """The columns as one JSON text, by name."""
    return F.to_json(F.struct(*[c.alias(n) for n, c in sorted(columns.items())]))
