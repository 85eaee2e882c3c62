"""Factor evaluation on a market calendar: forward returns, information coefficients, quantiles, turnover.

Steps on the calendar are RANGE frames over the session index: the row exactly p sessions away, or null where the entity
has none. One shuffle and sort by entity serves any number of steps, and no self-join is built.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import cross_section as x
from .joins import next_session


def at_step(value: str, p: int, entity: str = "entity_code", idx: str = "idx") -> Column:
    """The value of the same entity p sessions later (earlier for negative p), null if it has no row there."""
    return F.first(value).over(Window.partitionBy(entity).orderBy(idx).rangeBetween(p, p))


def forward_returns(prices: DataFrame, cal: DataFrame, periods: list[int]) -> DataFrame:
    """prices (entity_code, trade_date, price) -> with idx and fwd_p = price(i + p) / price(i) - 1 per period."""
    dated = prices.join(cal, "trade_date")
    return dated.withColumns({f"fwd_{p}": F.try_divide(at_step("price", p), F.col("price")) - 1 for p in periods})


def clean_factor(factor: DataFrame, prices: DataFrame, cal: DataFrame, periods: list[int], k: int = 5, max_loss: float = 0.9, edges: str = "count") -> DataFrame:
    """factor (entity_code, signal_date, factor) on its next session, with forward returns and quantile 1..k.

    edges: "count" for equal counts, "quantile" for the day's exact quantiles. Losing more of the rows than max_loss is
    an error.
    """
    moved = next_session(factor, cal).drop("signal_date")
    joined = moved.join(forward_returns(prices, cal, periods).drop("price"), ["entity_code", "trade_date"], "left")
    whole = F.col("factor").isNotNull() & ~F.isnan("factor")
    for p in periods:
        whole = whole & F.col(f"fwd_{p}").isNotNull()
    n = joined.agg(F.count("*").alias("n"), F.count(F.when(whole, 1)).alias("kept")).first()
    if n["n"] and 1 - n["kept"] / n["n"] > max_loss:
        raise ValueError(f"{n['n'] - n['kept']} of {n['n']} rows are lost")
    kept = joined.where(whole)
    if edges == "count":
        return kept.withColumn("quantile", x.equal_count_bucket("factor", k))
    cuts = kept.groupBy("trade_date").agg(F.percentile("factor", F.array(*[F.lit(i / k) for i in range(1, k)])).alias("__cuts"))
    met = kept.join(cuts, "trade_date")
    return met.withColumn("quantile", F.size(F.filter("__cuts", lambda e: F.col("factor") > e)) + 1).drop("__cuts")


def rank_corr(df: DataFrame, keys: list[str], a: str, b: str, out: str = "ic") -> DataFrame:
    """Spearman by group, ties with mean ranks: (keys, n, out); null where a side is constant."""
    both = x.dealt(df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*dict.fromkeys([*keys, a, b])), *keys)
    both = both.withColumns({"__a": x.mean_rank(a, keys), "__b": x.mean_rank(b, keys)})
    s = both.groupBy(*keys).agg(F.count("*").alias("n"), F.covar_pop("__a", "__b").alias("__c"), (F.stddev_pop("__a") * F.stddev_pop("__b")).alias("__s"))
    return s.withColumn(out, F.when(F.col("__s") > 0, F.col("__c") / F.col("__s"))).drop("__c", "__s")


def rank_corrs(df: DataFrame, keys: list[str], names: list[str], b: str) -> DataFrame:
    """Spearman by group of each of several columns with b: (keys, feature, n, ic) as rank_corr gives them one by one.

    A row is shuffled once for all columns."""
    rows = x.dealt(df.where(F.col(b).isNotNull()).select(*dict.fromkeys([*keys, *names, b])), *keys)
    rows = rows.withColumns({f"__on_{i}": F.col(n).isNotNull() for i, n in enumerate(names)})
    rank = lambda c, i: F.when(F.col(f"__on_{i}"), x.mean_rank(c, [*keys, f"__on_{i}"]))
    ranked = rows.withColumns({f"__{s}_{i}": rank(c, i) for i, n in enumerate(names) for s, c in (("a", n), ("b", b))})
    s = ranked.groupBy(*keys).agg(*[
        F.struct(F.lit(n).alias("feature"), F.count(f"__a_{i}").alias("n"), F.covar_pop(f"__a_{i}", f"__b_{i}").alias("c"), (F.stddev_pop(f"__a_{i}") * F.stddev_pop(f"__b_{i}")).alias("s")).alias(f"__{i}")
        for i, n in enumerate(names)
    ])
    each = s.select(*keys, F.explode(F.array(*[f"__{i}" for i in range(len(names))])).alias("e")).where("e.n > 0")
    return each.select(*keys, "e.feature", "e.n", F.when(F.col("e.s") > 0, F.col("e.c") / F.col("e.s")).alias("ic"))


def rank_ic(clean: DataFrame, periods: list[int]) -> DataFrame:
    """(trade_date, period, n, ic)."""
    long = clean.select("trade_date", "factor", F.explode(F.array(*[F.struct(F.lit(p).alias("period"), F.col(f"fwd_{p}").alias("ret")) for p in periods])).alias("f")).select("trade_date", "factor", "f.*")
    return rank_corr(long, ["trade_date", "period"], "factor", "ret")


def quantile_returns(clean: DataFrame, periods: list[int]) -> DataFrame:
    return clean.groupBy("trade_date", "quantile").agg(F.count("*").alias("n"), *[F.avg(f"fwd_{p}").alias(f"ret_{p}") for p in periods])


def turnover(clean: DataFrame, p: int) -> DataFrame:
    """(trade_date, quantile, turnover): the share of names that were not in the quantile p sessions before."""
    moved = clean.withColumn("__was", at_step("quantile", -p)).crossJoin(clean.agg(F.min("idx").alias("__first")))
    new = F.when(F.col("__was") == F.col("quantile"), 0.0).otherwise(1.0)
    return moved.where(F.col("idx") >= F.col("__first") + p).groupBy("trade_date", "quantile").agg(F.avg(new).alias("turnover"))


def rank_autocorr(clean: DataFrame, p: int) -> DataFrame:
    """(trade_date, autocorr): correlation of ranks with those of p sessions before."""
    ranked = clean.withColumn("__r", x.avg_rank("factor")).withColumn("__p", at_step("__r", -p)).where("__p is not null")
    s = ranked.groupBy("trade_date").agg(F.covar_pop("__r", "__p").alias("c"), (F.stddev_pop("__r") * F.stddev_pop("__p")).alias("s"))
    return s.select("trade_date", F.when(F.col("s") > 0, F.col("c") / F.col("s")).alias("autocorr"))


def analysis_summary(clean: DataFrame, periods: list[int], k: int = 5) -> DataFrame:
    """(metric, period, value): IC mean, deviation, positive share and count; top, bottom and spread of quantiles; mean
    turnover and rank autocorrelation over as many sessions; rows, dates and entities. All periods share each pass."""
    ic = rank_ic(clean, periods).groupBy("period").agg(F.avg("ic").alias("ic_mean"), F.stddev_samp("ic").alias("ic_std"), F.avg(F.when(F.col("ic").isNotNull(), (F.col("ic") > 0).cast("double"))).alias("ic_positive"), F.count("ic").cast("double").alias("ic_days"))
    daily = quantile_returns(clean, periods)
    side = lambda p, bucket: F.avg(F.when(F.col("quantile") == bucket, F.col(f"ret_{p}")))
    ends = daily.agg(F.array(*[F.struct(F.lit(p).alias("period"), side(p, k).alias("top"), side(p, 1).alias("bottom")) for p in periods]).alias("e")).select(F.explode("e").alias("e")).select("e.*")
    # Where each name stood so many sessions before, for all periods over one sort by entity.
    ranked = clean.withColumn("__r", x.avg_rank("factor"))
    lagged = ranked.withColumns({f"__{what}{p}": at_step(of, -p) for p in periods for what, of in (("q", "quantile"), ("r", "__r"))})
    long = lagged.select("trade_date", "quantile", "idx", "__r", F.explode(F.array(*[F.struct(F.lit(p).alias("period"), F.col(f"__q{p}").alias("was"), F.col(f"__r{p}").alias("before")) for p in periods])).alias("l")).select("*", "l.*")
    start = clean.agg(F.min("idx").alias("start"))
    new = F.when(F.col("was") == F.col("quantile"), 0.0).otherwise(1.0)
    moves = long.crossJoin(start).where(F.col("idx") >= F.col("start") + F.col("period")).groupBy("period", "trade_date", "quantile").agg(F.avg(new).alias("t")).groupBy("period").agg(F.avg("t").alias("turnover"))
    s = long.where("before is not null").groupBy("period", "trade_date").agg(F.covar_pop("__r", "before").alias("c"), (F.stddev_pop("__r") * F.stddev_pop("before")).alias("s"))
    steady = s.groupBy("period").agg(F.avg(F.when(F.col("s") > 0, F.col("c") / F.col("s"))).alias("autocorr"))
    counts = clean.agg(F.count("*").cast("double").alias("rows"), F.count_distinct("trade_date").cast("double").alias("dates"), F.count_distinct("entity_code").cast("double").alias("entities"))
    wide = ic.join(ends.withColumn("spread", F.col("top") - F.col("bottom")), "period").join(moves, "period", "left").join(steady, "period", "left").crossJoin(counts)
    return wide.unpivot(["period"], ["ic_mean", "ic_std", "ic_positive", "ic_days", "top", "bottom", "spread", "turnover", "autocorr", "rows", "dates", "entities"], "metric", "value")


def newey_west(series: DataFrame, value: str, lag: int, order: str = "trade_date") -> DataFrame:
    """(n, mean, t): t of the mean with Bartlett weights over so many lags. A row per date, so one window is small."""
    w = Window.orderBy(order)
    centred = series.where(F.col(value).isNotNull()).withColumn("__e", F.col(value) - F.avg(value).over(Window.partitionBy()))
    lags = centred.withColumns({f"__l{i}": F.lag("__e", i).over(w) for i in range(1, lag + 1)})
    s = lags.agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.sum(F.col("__e") ** 2).alias("g0"), *[F.coalesce(F.sum(F.col("__e") * F.col(f"__l{i}")), F.lit(0.0)).alias(f"g{i}") for i in range(1, lag + 1)])
    total = F.col("g0")
    for i in range(1, lag + 1):
        total = total + 2 * (1 - i / (lag + 1)) * F.col(f"g{i}")
    return s.select("n", "mean", F.when((total > 0) & (F.col("n") > 1), F.col("mean") / F.sqrt(total / F.col("n") / F.col("n"))).alias("t"))
