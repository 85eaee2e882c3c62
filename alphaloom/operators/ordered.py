"""Order statistics over whole columns without one task that sees them all.

Values of a key are dealt into cells: a fixed number of ranges of even width, narrow near the typical size of a value and
wider beyond it. A cell is computed by arithmetic alone, so no column is sorted as a whole. Running sums come from the sums of
the cells before (a few thousand rows per key) and a running sum within the cell; quantiles from the one cell that holds
their rank, which is divided again until it is small.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.sinks import stored

#: Cells per key and round.
CELLS = 4096
#: Rows of one key, or of one cell, that one task may put in order.
SMALL = 1_000_000
#: Keys up to which their ranges are broadcast (some 50 bytes each).
FEW = 200_000


def cell(v: Column) -> Column:
    """The number of v's cell in the range of its row: never falling with v, from 0 to CELLS - 1.

    Cells are even within the scale of the centre, and logarithmic beyond it.
    """

    def bent(x: Column) -> Column:
        return F.asinh(F.least(F.greatest((x - F.col("__centre")) / F.col("__scale"), F.lit(-1e300)), F.lit(1e300)))

    a, b = bent(F.col("__low")), bent(F.col("__high"))
    share = F.when(b > a, (bent(v) - a) / (b - a)).otherwise(0.0)
    return F.least(F.floor(share * CELLS), F.lit(CELLS - 1)).cast("int")


def met(rows: DataFrame, small: DataFrame, keys: list[str]) -> DataFrame:
    """rows with the row of their key, which is sent to all executors if there are few; nulls are keys as others."""
    if small.limit(FEW + 1).count() <= FEW:
        small = F.broadcast(small)
    if not keys:
        return rows.crossJoin(small)  # one row
    renamed = small.withColumnsRenamed({k: f"__of_{k}" for k in keys})
    same = reduce(Column.__and__, [rows[k].eqNullSafe(renamed[f"__of_{k}"]) for k in keys])
    return rows.join(renamed, same).drop(*[f"__of_{k}" for k in keys])


RANGE = ("__low", "__high", "__centre", "__scale")


def ranges(rows: DataFrame, value: str, keys: list[str], **also: Column) -> DataFrame:
    """(keys, RANGE, __n, also...): of each key's values the ends, about their median, and how far half of them spread."""
    quarter = F.percentile_approx(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), 200)
    s = rows.groupBy(*keys).agg(F.min(value).alias("__low"), F.max(value).alias("__high"), quarter.alias("__q"), F.count("*").alias("__n"), *[c.alias(a) for a, c in also.items()])
    spread = F.nullif(F.col("__q")[2] - F.col("__q")[0], F.lit(0.0))
    return s.withColumns({"__centre": F.col("__q")[1], "__scale": F.coalesce(spread, F.nullif(F.col("__high") - F.col("__low"), F.lit(0.0)), F.lit(1.0))}).drop("__q")


def _finite(df: DataFrame, value: str) -> DataFrame:
    v = F.col(value)
    return df.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))


def gaps(df: DataFrame, value: str, a: Column, b: Column, keys: list[str]) -> DataFrame:
    """(keys, gap): the largest distance between the shares of a and b (counts of a row on either side) up to any value.

    Cells are counted first. At the end of each the distance is known, and within one it cannot pass what the cell's own rows
    of one side would add. So only cells in which it may pass the largest one known are put in order, their equal values
    counted together; the others' rows are not shuffled. Rows are read three times. Null if a side is empty; values that are
    not finite play no part.
    """
    rows = _finite(df.select(*keys, F.col(value).cast("double").alias("__v"), a.cast("long").alias("__a"), b.cast("long").alias("__b")), "__v").where("__a > 0 or __b > 0")
    of = stored(ranges(rows, "__v", keys, __na=F.sum("__a"), __nb=F.sum("__b")))
    placed = met(rows, of, keys).withColumn("__cell", cell(F.col("__v")))
    sums = stored(placed.groupBy(*keys, "__cell", "__na", "__nb").agg(F.sum("__a").alias("__a"), F.sum("__b").alias("__b"), (F.min("__v") < F.max("__v")).alias("__several")))
    before = Window.partitionBy(*keys).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    share = lambda a, b: a / F.nullif("__na", F.lit(0)) - b / F.nullif("__nb", F.lit(0))
    at, end = share(F.col("__pa"), F.col("__pb")), share(F.col("__pa") + F.col("__a"), F.col("__pb") + F.col("__b"))
    cells = sums.withColumns({"__pa": F.coalesce(F.sum("__a").over(before), F.lit(0)), "__pb": F.coalesce(F.sum("__b").over(before), F.lit(0))}).withColumn("__end", F.abs(end))
    reach = F.greatest(F.abs(at + F.col("__a") / F.nullif("__na", F.lit(0))), F.abs(at - F.col("__b") / F.nullif("__nb", F.lit(0))))
    known = F.max("__end").over(Window.partitionBy(*keys))  # a row per cell
    open_ = stored(cells.withColumn("__open", F.col("__several") & (reach + 1e-12 > known)).where("__open").select(*keys, "__cell", "__na", "__nb", "__pa", "__pb"))
    counts = met(placed.select(*keys, "__cell", "__v", "__a", "__b"), open_, [*keys, "__cell"]).groupBy(*keys, "__cell", "__na", "__nb", "__pa", "__pb", "__v").agg(F.sum("__a").alias("__a"), F.sum("__b").alias("__b"))
    within = Window.partitionBy(*keys, "__cell").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    inner = counts.select(*keys, F.abs(share(F.col("__pa") + F.sum("__a").over(within), F.col("__pb") + F.sum("__b").over(within))).alias("__gap"))
    ends = cells.select(*keys, F.col("__end").alias("__gap"))
    return ends.unionByName(inner).groupBy(*keys).agg(F.max("__gap").alias("gap"))


def wins(df: DataFrame, value: str, a: Column, b: Column, keys: list[str]) -> DataFrame:
    """(keys, wins, na, nb): pairs of a row of a and one of b in which a's value is larger, ties half, out of na * nb."""
    rows = df.select(*keys, F.col(value).cast("double").alias("__v"), a.cast("long").alias("__a"), b.cast("long").alias("__b")).where("__v is not null")
    counts = rows.groupBy(*keys, "__v").agg(F.sum("__a").alias("__a"), F.sum("__b").alias("__b"))
    of = stored(ranges(rows, "__v", keys))
    placed = met(counts, of, keys).withColumn("__cell", cell(F.col("__v")))
    before = lambda *by: F.coalesce(F.sum("__b").over(Window.partitionBy(*keys, *by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = placed.withColumn("__w", F.col("__a") * (before("__cell", "__v") + F.col("__b") / 2))
    cells = own.groupBy(*keys, "__cell").agg(F.sum("__w").alias("__w"), F.sum("__a").alias("__a"), F.sum("__b").alias("__b"))
    whole = cells.withColumn("__w", F.col("__w") + F.col("__a") * before("__cell"))
    return whole.groupBy(*keys).agg(F.sum("__w").alias("wins"), F.sum("__a").alias("na"), F.sum("__b").alias("nb"))


def exact_quantiles(df: DataFrame, value: str, points: list[float], keys: list[str], small: int = SMALL) -> DataFrame:
    """(keys, n, q): q the exact quantiles at the points, in their order, interpolated between neighbours.

    All keys and points share each pass. Where no key has more than `small` values they are put in order at once. Else each
    round counts the cells of what is left of each key and keeps only the cells that hold a rank in question, until these are
    small or of one value; a round divides by up to CELLS. Null, NaN and infinite values play no part; a key without values is
    not in the result. Keys are few (features, sides of a split).
    """
    rows = _finite(df.select(*keys, F.col(value).cast("double").alias("v")), "v")
    base = stored(ranges(rows, "v", keys).withColumn("g", F.monotonically_increasing_id()))
    most = base.agg(F.max("__n")).first()[0] or 0
    if most <= small:
        return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.percentile("v", F.array(*map(F.lit, points))).alias("q"))
    at = F.explode(F.array(*[F.struct(F.lit(i).alias("point"), F.lit(float(p)).alias("p")) for i, p in enumerate(points)]))
    asked = base.select("g", F.col("g").alias("of"), "__n", at.alias("x")).withColumn("r", F.col("x.p") * (F.col("__n") - 1)).select("g", "of", F.col("x.point").alias("point"), "r")
    # Two ranks per point, counted within g: the one below and the one above.
    asked = stored(asked.select("g", "of", "point", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.floor("r").alias("k")), F.struct(F.lit(1).alias("side"), F.ceil("r").alias("k")))).alias("x")).select("g", "of", "point", "x.side", "x.k"))
    groups, left, answers = base.select("g", *RANGE), met(rows, base.select(*keys, "g"), keys).select("g", "v"), []
    for _ in range(64):
        cells = left.join(F.broadcast(groups), "g").withColumn("cell", cell(F.col("v")))
        own = Window.partitionBy("g").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
        counts = cells.groupBy("g", "cell").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        counts = counts.withColumn("before", F.coalesce(F.sum("n").over(own), F.lit(0)))
        hit = stored(asked.join(counts, "g").where((F.col("k") >= F.col("before")) & (F.col("k") < F.col("before") + F.col("n"))).select("g", "of", "point", "side", (F.col("k") - F.col("before")).alias("k"), "cell", "n", "low", "high"))
        answers.append(hit.where("low = high").select("of", "point", "side", F.col("low").alias("v")))
        hit = hit.where("low < high")
        needed = stored(hit.select("g", "cell", "n", "low", "high").distinct().withColumn("inner", F.monotonically_increasing_id()))
        left = cells.select("g", "cell", "v").join(F.broadcast(needed.select("g", "cell", "inner")), ["g", "cell"]).select(F.col("inner").alias("g"), "v")
        asked = hit.join(needed.select("g", "cell", "inner"), ["g", "cell"]).select(F.col("inner").alias("g"), "of", "point", "side", "k")
        ends = (F.col("low").alias("__low"), F.col("high").alias("__high"), F.col("low").alias("__centre"), (F.col("high") - F.col("low")).alias("__scale"))
        groups = needed.select(F.col("inner").alias("g"), *ends)
        if (needed.agg(F.max("n")).first()[0] or 0) <= small:
            break
    own = Window.partitionBy("g").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    placed = left.groupBy("g", "v").agg(F.count("*").alias("c")).withColumn("upto", F.sum("c").over(own))
    answers.append(asked.join(placed, "g").where((F.col("k") < F.col("upto")) & (F.col("k") >= F.col("upto") - F.col("c"))).select("of", "point", "side", "v"))
    found = reduce(DataFrame.unionByName, answers).groupBy("of", "point").agg(F.max(F.when(F.col("side") == 0, F.col("v"))).alias("a"), F.max(F.when(F.col("side") == 1, F.col("v"))).alias("b"))
    p = F.element_at(F.array(*map(lambda x: F.lit(float(x)), points)), F.col("point") + 1)
    full = found.join(base.select("g", F.col("__n").alias("n"), *keys), found["of"] == base["g"])
    share = p * (F.col("n") - 1) - F.floor(p * (F.col("n") - 1))
    between = F.when(F.col("a") == F.col("b"), F.col("a")).otherwise((1 - share) * F.col("a") + share * F.col("b"))
    gathered = full.withColumn("q", between).groupBy("g", *keys, "n").agg(F.array_sort(F.collect_list(F.struct("point", "q"))).alias("q"))
    return gathered.select(*keys, "n", F.transform("q", lambda x: x["q"]).alias("q"))
