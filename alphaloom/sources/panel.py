"""The daily panel: bars from trades, and bars joined with status and extra fields, one row per entity and date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.cross_section import dealt
from ..operators.joins import left_any

#: Texts that mean true in status columns.
TRUE = ("1", "true", "True")


def bars(trades: DataFrame, grain: str = "week", entity: str = "entity_code", time: str = "trade_time", tie: tuple[str, ...] = (), deal: bool = False) -> DataFrame:
    """trades (entity, time, price, volume, amount) -> open, high, low, close, volume, amount per entity and period.

    The first and the last trade are those by (time, *tie); tie must make the order total for a defined result. The
    aggregates are partial before the shuffle, so busy entities do not matter; the price is shuffled once, within the order. deal: trades are dealt by entity and period
    instead and sorted once, there, where a task holds few of them; for bars that are stored, as all columns are shuffled.
    """
    order = F.struct(time, *tie, "price")
    dated = trades.withColumn("__period", F.to_date(F.date_trunc(grain, F.col(time))))
    rows = dealt(dated, entity, "__period") if deal else dated
    return rows.groupBy(entity, F.col("__period").alias("trade_date")).agg(
        F.min(order)["price"].alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max(order)["price"].alias("close"),
        F.sum("volume").alias("volume"),
        F.sum("amount").alias("amount"),
    )


def flag(x: Column) -> Column:
    """1 for the texts that mean true, 0 for all others and null."""
    return F.coalesce(x.cast("string").isin(*TRUE), F.lit(False)).cast("int")


#: Flags of boards by exchange suffix and number prefix.
BOARD_FLAGS = {"is_kcb": ("SH", "688"), "is_cyb": ("SZ", "300"), "is_bjs": ("BJ", "")}


def panel(bars: DataFrame, status: DataFrame, extras: DataFrame, on: tuple[str, str] = ("entity_code", "trade_date"), suspended: str = "is_susp", trading: str = "tradestatus") -> DataFrame:
    """bars left-any-joined to status (numbers, is_... texts) and extras (numbers as text, the text `trading`).

    Numbers in text are cast where they can be; other texts are null. A number that both have is that of status, or else
    that of extras. A bar is suspended if status says so or if its trading text is 0. A bar without status has flags 0.
    Adds the flags of boards.
    """
    flags = [c for c in status.columns if c.startswith("is_")]
    numbers = [c for c in status.columns if c not in (*on, *flags)]
    texts = [c for c in extras.columns if c not in (*on, trading)]
    wide = left_any(bars, status.select(*on, *numbers, *flags), on)
    more = extras.select(*on, *[F.col(c).try_cast("double").alias(f"__{c}" if c in numbers else c) for c in texts], *([trading] if trading in extras.columns else []))
    wide = left_any(wide, more, on).withColumns({c: flag(F.col(c)) for c in flags})
    both = [c for c in numbers if c in texts]
    wide = wide.withColumns({c: F.coalesce(F.col(c).cast("double"), F.col(f"__{c}")) for c in both}).drop(*[f"__{c}" for c in both])
    if trading in extras.columns and suspended in flags:
        wide = wide.withColumn(suspended, F.greatest(suspended, F.coalesce((F.col(trading) == "0").cast("int"), F.lit(0)))).drop(trading)
    number, exchange = F.substring_index(on[0], ".", 1), F.substring_index(on[0], ".", -1)
    return wide.withColumns({name: ((exchange == e) & number.startswith(prefix)).cast("int") for name, (e, prefix) in BOARD_FLAGS.items()})


def basics(df: DataFrame, code: str = "code", kind: str = "type") -> DataFrame:
    return df.select(F.col(code).alias("entity_code"), F.col(kind).cast("string").alias("type"))


def market_history(bars: DataFrame, code: str, through: str, limit: int = 120) -> DataFrame:
    """The last `limit` bars of one entity up to a date, ascending; bars without positive prices do not count."""
    if not 10 <= limit <= 240:
        raise ValueError("limit must be from 10 to 240")
    priced = bars.where((F.col("entity_code") == code) & (F.col("trade_date") <= F.lit(through).cast("date")))
    for c in ("open", "high", "low", "close"):
        priced = priced.where(F.col(c) > 0)
    return priced.orderBy(F.col("trade_date").desc()).limit(limit).orderBy("trade_date")


def calendar(bars: DataFrame, code: str | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """(trade_date, idx from 0): distinct dates, of one entity or of all. The window runs over one row per date."""
    rows = bars if code is None else bars.where(F.col("entity_code") == code)
    if start is not None:
        rows = rows.where(F.col("trade_date") >= F.lit(start).cast("date"))
    if end is not None:
        rows = rows.where(F.col("trade_date") <= F.lit(end).cast("date"))
    days = rows.select("trade_date").distinct()
    return days.withColumn("idx", F.row_number().over(Window.orderBy("trade_date")).cast("long") - 1)


def sessions_ending_at(cal: DataFrame, day: str, k: int) -> DataFrame:
    """The last k sessions up to day; an error if day is no session or there are fewer."""
    last = cal.where(F.col("trade_date") <= F.lit(day).cast("date")).orderBy(F.col("trade_date").desc()).limit(k)
    found = last.agg(F.count("*").alias("n"), F.max("trade_date").alias("day")).first()
    if found["n"] < k or str(found["day"]) != day:
        raise ValueError(f"{day} is no session with {k - 1} before it")
    return last.orderBy("trade_date")


def source_range(df: DataFrame) -> DataFrame:
    """First and last date, and the default range, which is the last date alone."""
    r = df.agg(F.min("trade_date").alias("first_date"), F.max("trade_date").alias("last_date"))
    return r.withColumns({"default_start": F.col("last_date"), "default_end": F.col("last_date")})


def source_profile(df: DataFrame, fields: list[str]) -> DataFrame:
    """One row per field: rows, entities, first and last date, share of values in percent. One pass."""
    one = df.agg(
        F.count("*").alias("rows"), F.count_distinct("entity_code").alias("entities"), F.min("trade_date").alias("first_date"),
        F.max("trade_date").alias("last_date"), *[F.count(f).alias(f"n_{f}") for f in fields],
    )
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.try_divide(F.col(f"n_{f}") * 100.0, F.col("rows")).alias("filled_pct")) for f in fields]))
    return one.select("rows", "entities", "first_date", "last_date", each.alias("f")).select("f.field", "rows", "entities", "first_date", "last_date", "f.filled_pct")


def with_fields(panel: DataFrame, extra: DataFrame, fields: list[str], on: tuple[str, str] = ("entity_code", "trade_date")) -> DataFrame:
    """The panel with more numeric fields from another keyed table. Booleans become 1 and 0, what is not finite null.

    A text that is no number is an error.
    """
    kinds = dict(extra.dtypes)
    typed = extra.select(*on, *[F.col(f).cast("int").cast("double").alias(f) if kinds[f] == "boolean" else F.col(f).try_cast("double").alias(f) for f in fields], *[F.col(f).alias(f"__{f}") for f in fields])
    failed = typed.agg(*[F.count(F.when(F.col(f).isNull() & F.col(f"__{f}").isNotNull(), 1)).alias(f) for f in fields]).first()
    if wrong := [f for f in fields if failed[f]]:
        raise ValueError(f"fields that are not numeric: {wrong}")
    clean = typed.select(*on, *[F.when(~F.isnan(f) & (F.abs(F.col(f)) < float("inf")), F.col(f)).alias(f) for f in fields])
    return left_any(panel, clean, on)


def latest_name(names: DataFrame) -> DataFrame:
    """names (entity_code, name, snapshot_date) -> the latest name that is not empty."""
    return names.where(F.trim("name") != "").groupBy("entity_code").agg(F.max_by("name", F.struct("snapshot_date", "name")).alias("name"))
