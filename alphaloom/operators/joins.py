"""Joins, point-in-time visibility, deduplication and universes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import board, signal_close

KEY = ("entity_code", "trade_date")


def latest_by(df: DataFrame, keys: list[str] | tuple[str, ...], order: list[str]) -> DataFrame:
    """One row per key, the largest by order. An aggregation of a struct, partial before the shuffle: no sort."""
    rest = [c for c in df.columns if c not in keys]
    top = df.groupBy(*keys).agg(F.max(F.struct(*order, *[c for c in rest if c not in order])).alias("__top"))
    return top.select(*[F.col(c) if c in keys else F.col("__top")[c].alias(c) for c in df.columns])


def left_any(left: DataFrame, right: DataFrame, on: tuple[str, ...] | list[str]) -> DataFrame:
    """Left join to at most one right row per key: the largest by its columns, so the result is defined."""
    on = list(on)
    values = [c for c in right.columns if c not in on]
    one = right.groupBy(*on).agg(F.max(F.struct(*values)).alias("__one"))
    return left.join(one, on, "left").select(*left.columns, *[F.col("__one")[c].alias(c) for c in values])


def semi_universe(df: DataFrame, basics: DataFrame, kind: str = "1") -> DataFrame:
    return df.join(basics.where(F.col("type") == kind).select("entity_code"), "entity_code", "left_semi")


def asof_join(left: DataFrame, right: DataFrame, by: str, on: str, value: str, default: float | None = None, out: str | None = None, unit: str | None = "month") -> DataFrame:
    """Adds to each left row the right value of the same `by` with the latest `on` that is not later.

    Both sides are put one under the other and the last right value is carried forward: one shuffle and one sort,
    whatever the sizes, and no pair of rows is ever built. Of right rows at one time the largest value counts.

    Times are cut into slices of one unit, so that a `by` of many rows is many groups: the last value of each slice, carried
    over the slices of its `by`, is put at the beginning of the next ones. What is no date or time, and with unit None, is
    not cut.
    """
    unit = unit if dict(left.dtypes)[on].startswith(("date", "timestamp")) else None
    out = out or value
    cols, kind = left.columns, dict(right.dtypes)[value]
    slice_ = (lambda c: F.date_trunc(unit, c)) if unit else (lambda c: F.lit(0))
    right_one = right.where(F.col(by).isNotNull() & F.col(on).isNotNull()).groupBy(by, on).agg(F.max(value).alias("__value"))
    tagged = left.withColumn("__row", F.struct(*cols)).select(F.col(by).alias("__by"), slice_(F.col(on)).alias("__slice"), F.col(on).alias("__on"), F.lit(1).alias("__side"), F.lit(None).cast(kind).alias("__value"), "__row")
    none = F.lit(None).cast(tagged.schema["__row"].dataType).alias("__row")
    other = right_one.select(F.col(by).alias("__by"), slice_(F.col(on)).alias("__slice"), F.col(on).alias("__on"), F.lit(0).alias("__side"), "__value", none)
    rows = tagged.unionByName(other)
    if unit:
        ends = other.where("__value is not null").groupBy("__by", "__slice").agg(F.max_by("__value", "__on").alias("__end"))
        asked = tagged.select("__by", "__slice").distinct().withColumn("__end", F.lit(None).cast(kind))
        slices = ends.unionByName(asked).groupBy("__by", "__slice").agg(F.max("__end").alias("__end"))  # a row per slice
        past = Window.partitionBy("__by").orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
        begin = slices.withColumn("__value", F.last("__end", ignorenulls=True).over(past)).where("__value is not null")
        rows = rows.unionByName(begin.select("__by", "__slice", F.lit(None).cast(tagged.schema["__on"].dataType).alias("__on"), F.lit(-1).alias("__side"), "__value", none))
    before = Window.partitionBy("__by", "__slice").orderBy(F.col("__on").asc_nulls_first(), "__side").rowsBetween(Window.unboundedPreceding, 0)
    carried = rows.withColumn("__last", F.last("__value", ignorenulls=True).over(before)).where("__side = 1")
    timed = F.when(F.col("__on").isNotNull(), F.col("__last"))
    return carried.select(*[F.col("__row")[c].alias(c) for c in cols], (timed if default is None else F.coalesce(timed, F.lit(default))).alias(out))


def adjusted(bars: DataFrame, factors: DataFrame, prices: tuple[str, ...] = ("open", "close")) -> DataFrame:
    """bars with adjusted_... prices; factors (entity_code, trade_date, factor) hold from their date on, 1 before."""
    wide = asof_join(bars, factors, "entity_code", "trade_date", "factor", 1.0)
    return wide.withColumns({f"adjusted_{p}": F.col(p) * F.col("factor") for p in prices})


def market_cap(bars: DataFrame, shares: DataFrame) -> DataFrame:
    """Adds cap = close * shares * 10000 and log_cap; shares (entity_code, ann_date, change_date, total_share).

    A row of shares is known from the later of announcement and change.
    """
    known = shares.where("total_share > 0").select("entity_code", F.greatest("ann_date", "change_date").alias("trade_date"), "total_share")
    wide = asof_join(bars, known, "entity_code", "trade_date", "total_share")
    cap = F.col("close") * F.col("total_share") * 10000
    return wide.withColumn("cap", cap).withColumn("log_cap", F.when(F.col("cap") > 0, F.log("cap")))


def sessions_from(days: DataFrame, day: str, cal: DataFrame, strict: bool = False) -> DataFrame:
    """(day, session, idx): for each date the first session that is not before it, or with strict the first after it.

    Dates and sessions are put in one order and the next session is carried back: a row per date on either side.
    """
    asked = days.select(F.col(day).alias("__day")).where("__day is not null").distinct()
    rows = asked.select("__day", F.unix_date("__day").alias("__on"), F.lit(None).cast("struct<session:date,idx:long>").alias("__s"))
    own = cal.select(F.lit(None).cast("date").alias("__day"), F.unix_date("trade_date").alias("__on"), F.struct(F.col("trade_date").alias("session"), F.col("idx").cast("long").alias("idx")).alias("__s"))
    ahead = Window.orderBy("__on").rangeBetween(int(strict), Window.unboundedFollowing)
    found = rows.unionByName(own).withColumn("__n", F.min("__s").over(ahead)).where("__day is not null")
    return found.select(F.col("__day").alias(day), F.col("__n.session").alias("session"), F.col("__n.idx").alias("idx"))


def membership(cal: DataFrame, members: DataFrame) -> DataFrame:
    """(trade_date, entity_code) for the sessions within [in_date, out_date], open where out_date is null.

    Both dates are turned into positions on the calendar and the positions between them met with it by equality. Spans of one
    entity may overlap; each session comes once.
    """
    first = sessions_from(members, "in_date", cal).select("in_date", F.col("idx").alias("__a"))
    after = sessions_from(members, "out_date", cal, strict=True).select("out_date", F.col("idx").alias("__b"))
    end = cal.agg((F.max("idx") + 1).alias("__end"))
    placed = members.join(first, "in_date").join(after, "out_date", "left").crossJoin(end)
    spans = placed.withColumn("__stop", F.coalesce("__b", "__end") - 1).where("__a <= __stop")
    # A span starts after those before it, so no session comes twice and the sessions need no distinct.
    before = Window.partitionBy("entity_code").orderBy("__a", "__stop").rowsBetween(Window.unboundedPreceding, -1)
    own = spans.withColumn("__a", F.greatest("__a", F.max("__stop").over(before) + 1)).where("__a <= __stop")
    days = own.select("entity_code", F.explode(F.sequence("__a", "__stop")).alias("idx"))
    return days.join(F.broadcast(cal.select("trade_date", F.col("idx").cast("long").alias("idx"))), "idx").select("entity_code", "trade_date")  # a row per session


def membership_all(bars: DataFrame, basics: DataFrame, kind: str = "1") -> DataFrame:
    return semi_universe(bars.select(*KEY).distinct(), basics, kind)


def filter_universe(signals: DataFrame, members: DataFrame, day: str = "signal_date") -> DataFrame:
    return signals.join(members.select("entity_code", F.col("trade_date").alias(day)), ["entity_code", day], "left_semi")


def industry_daily(obs: DataFrame, weights: DataFrame, base: DataFrame, coverage: float = 0.8, first: str = "2021-12-13") -> DataFrame:
    """obs (entity_code, trade_date) with the level-1 industry of exactly that date.

    weights (index_code, entity_code, trade_date, weight), base (index_code, level_type, level1_name). Dates before
    `first`, two industries for one row, and coverage below the share are errors.
    """
    level1 = base.where(F.col("level_type").cast("int") == 1).select("index_code", F.col("level1_name").alias("industry"))
    named = weights.where("weight > 0").join(level1, "index_code").select(*KEY, "industry").distinct()
    joined = obs.join(named, list(KEY), "left")
    s = joined.agg(F.min("trade_date").alias("first"), F.count("*").alias("n"), F.count("industry").alias("k")).first()
    twice = joined.where("industry is not null").groupBy(*KEY).count().where("count > 1").take(1)
    if s["n"] and str(s["first"]) < first:
        raise ValueError(f"no industries before {first}")
    if twice:
        raise ValueError("a row has two industries")
    if s["n"] and s["k"] < coverage * s["n"]:
        raise ValueError(f"industries cover {s['k']} of {s['n']} rows")
    return joined.where("industry is not null")


def industry_interval(obs: DataFrame, intervals: DataFrame) -> DataFrame:
    """obs with the industry of the interval it lies in; of overlapping ones the latest in_date, then the larger name."""
    met = obs.join(intervals, "entity_code").where("trade_date >= in_date and (out_date is null or trade_date <= out_date)")
    best = met.groupBy(*KEY).agg(F.max(F.struct("in_date", "industry")).alias("b"))
    return obs.join(best.select(*KEY, F.col("b.industry").alias("industry")), list(KEY), "left")


def sample_filters(df: DataFrame, listed: DataFrame, cal: DataFrame, min_sessions: int = 60, boards: tuple[str, ...] = (), drop_st: bool = True, drop_wd: bool = True, both_ways: bool = True) -> DataFrame:
    """Rows that may be held: right board, listed for so many sessions, not delisted, neither ST nor in withdrawal, and
    tradable both ways. listed (entity_code, ipo_date, out_date); df has is_st, is_wd, buy_allowed, sell_allowed."""
    first = listed.join(sessions_from(listed, "ipo_date", cal), "ipo_date").where("idx is not null").select("entity_code", "out_date", F.col("idx").alias("ipo_idx"))
    out = df.join(first, "entity_code").join(cal, "trade_date").where(F.col("idx") - F.col("ipo_idx") >= min_sessions)
    out = out.where("out_date is null or trade_date < out_date")
    if boards:
        out = out.where(board(F.col("entity_code")).isin(*boards))
    if drop_st:
        out = out.where("is_st = 0")
    if drop_wd:
        out = out.where("is_wd = 0")
    if both_ways:
        out = out.where("buy_allowed = 1 and sell_allowed = 1")
    return out.select(*df.columns)


def as_known_at(df: DataFrame, at: Column) -> DataFrame:
    """Rows written by then."""
    return df.where(F.col("available_at") <= at)


def as_of_event(df: DataFrame, at: Column | None = None, per_row: bool = False, latest: bool = False) -> DataFrame:
    """Rows whose event was known: at one time, at 15:00 of their own date, or all. Exactly one must be asked for."""
    if (at is not None) + per_row + latest != 1:
        raise ValueError("ask for exactly one of at, per_row, latest")
    if latest:
        return df
    return df.where(F.col("event_available_at") <= (at if at is not None else signal_close(F.col("trade_date"))))


def latest_rows(df: DataFrame, keys: tuple[str, ...] = KEY) -> DataFrame:
    return latest_by(df, keys, ["computed_at", "updated_at"])


def latest_predictions(df: DataFrame, keys: tuple[str, ...] = (*KEY, "model_id")) -> DataFrame:
    return latest_by(df, keys, ["updated_at", "computed_at", "run_id"])


def final(df: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """The last version of each key, by updated_at; ties go to the row that is larger in its other columns, in their order."""
    return latest_by(df, keys, ["updated_at"])


def signal_revision(values: DataFrame, start: str, end: str) -> DataFrame:
    """(factor_version, params_hash): the newest version with rows in the range, then the one computed last."""
    inside = values.where(F.col("trade_date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    found = inside.groupBy("factor_version", "params_hash").agg(F.max("computed_at").alias("computed_at"), F.count("*").alias("rows"))
    return found.orderBy(F.col("factor_version").desc(), F.col("computed_at").desc(), "params_hash").limit(1)


def signal_dates(values: DataFrame) -> DataFrame:
    """Adds signal_date, the later of trade date and event date; of one entity and signal date the last trade date stays."""
    dated = values.withColumn("signal_date", F.greatest("trade_date", F.to_date("event_available_at")))
    return latest_by(dated, ("entity_code", "signal_date"), ["trade_date"])


def next_session(df: DataFrame, cal: DataFrame, day: str = "signal_date", out: str = "trade_date") -> DataFrame:
    """Adds the first session after day; rows without one go. The dates, not the rows, meet the calendar."""
    after = sessions_from(df, day, cal, strict=True).where("session is not null").select(day, F.col("session").alias(out))
    return df.join(after, day)


def backtest_range(values: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The range that all factors and the benchmark have: (start_date, end_date)."""
    each = values.groupBy("factor_id").agg(F.min("trade_date").alias("lo"), F.max("trade_date").alias("hi"))
    common = each.agg(F.max("lo").alias("lo"), F.min("hi").alias("hi"))
    b = benchmark.agg(F.min("trade_date").alias("blo"), F.max("trade_date").alias("bhi"))
    return common.crossJoin(b).select(F.greatest("lo", "blo").alias("start_date"), F.least("hi", "bhi").alias("end_date"))


def ready_dates(members: DataFrame, panel: DataFrame, fields: list[str], share: float = 0.8) -> DataFrame:
    """Dates on which this share of the members has all fields: (trade_date, members, ready, share)."""
    whole = F.lit(True)
    for f in fields:
        whole = whole & F.col(f).isNotNull()
    joined = members.join(panel.select(*KEY, whole.alias("__whole")), list(KEY), "left")
    n = joined.groupBy("trade_date").agg(F.count("*").alias("members"), F.count(F.when(F.col("__whole"), 1)).alias("ready"))
    return n.withColumn("share", F.col("ready") / F.col("members")).where(F.col("share") >= share)


def common_dates(predictions: DataFrame, models: list[str]) -> DataFrame:
    """(trade_date, entities): dates with entities that all models predicted."""
    full = predictions.where(F.col("model_id").isin(*models)).groupBy(*KEY).agg(F.count_distinct("model_id").alias("k")).where(F.col("k") == len(models))
    return full.groupBy("trade_date").agg(F.count("*").alias("entities"))


def compare_keys(a: DataFrame, b: DataFrame, on: tuple[str, ...] = KEY) -> DataFrame:
    """(both, left_only, right_only) over distinct keys."""
    one = a.select(*on).distinct().withColumn("__a", F.lit(1))
    two = b.select(*on).distinct().withColumn("__b", F.lit(1))
    met = one.join(two, list(on), "full_outer")
    return met.agg(F.count(F.when(F.col("__a").isNotNull() & F.col("__b").isNotNull(), 1)).alias("both"), F.count(F.when(F.col("__b").isNull(), 1)).alias("left_only"), F.count(F.when(F.col("__a").isNull(), 1)).alias("right_only"))
