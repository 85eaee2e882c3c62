"""What all queries share: the panel that the test tables give, in Spark and in SQL, and how results are put in shape."""

from __future__ import annotations

from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import panel as source
from ..sources.sinks import scratch


#: Six places, fewer for large values. Exact halves are kept clear of the edge, so both engines round them alike.
ROUNDED = """CASE WHEN isfinite(({v})::DOUBLE) THEN floor(({v})::DOUBLE * CASE WHEN abs(({v})::DOUBLE) < 1e4 THEN 1e6 WHEN abs(({v})::DOUBLE) < 1e8 THEN 1e2 ELSE 1e-2 END + 0.5000001)
 / CASE WHEN abs(({v})::DOUBLE) < 1e4 THEN 1e6 WHEN abs(({v})::DOUBLE) < 1e8 THEN 1e2 ELSE 1e-2 END END AS {v}"""


class Registry:
    """Queries and their SQL by name. keys are returned as they are, vals rounded, ints as longs.

    Values that are not finite count as null on both sides.
    """

    def __init__(self):
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, keys: str = "", vals: str = "", ints: str = "", sql: str | None = None, share: bool | tuple[str, ...] = False):
        """share: tables that `once` names, all or those given, are stored and read again while this query is put together."""

        def register(make: Callable[[SparkSession, str], DataFrame]):
            def run(spark: SparkSession, sf_dir: str) -> DataFrame:
                token = _shared.set((share, {}) if share else None)
                try:
                    return shape(make(spark, sf_dir), keys.split(), vals.split(), ints.split())
                finally:
                    _shared.reset(token)

            self.queries[name] = run
            if sql is not None:
                cols = [*keys.split(), *(ROUNDED.format(v=v) for v in vals.split()), *(f"({i})::BIGINT AS {i}" for i in ints.split())]
                self.sql[name] = f"SELECT {', '.join(cols)} FROM ({sql})"
            return make

        return register


#: What the query now put together shares, and the tables that it has stored, by name.
_shared: ContextVar[tuple[bool | tuple[str, ...], dict[str, DataFrame]] | None] = ContextVar("shared", default=None)


def once(name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """make(), stored in the shared scratch folder the first time within a query that shares its tables."""
    names, have = _shared.get() or ((), {})
    if names is not True and name not in names:
        return make()
    if name not in have:
        df = make()
        path = scratch(df.sparkSession, name)
        df.write.parquet(path)
        have[name] = df.sparkSession.read.schema(df.schema).parquet(path)
    return have[name]


def shape(df: DataFrame, keys: list[str], vals: list[str], ints: list[str]) -> DataFrame:
    def rounded(v: str) -> Column:
        x = F.col(v).cast("double")
        scale = F.when(F.abs(x) < 1e4, 1e6).when(F.abs(x) < 1e8, 1e2).otherwise(1e-2)
        return F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), F.floor(x * scale + 0.5000001) / scale).alias(v)

    return df.select(*keys, *[rounded(v) for v in vals], *[F.col(i).cast("long").alias(i) for i in ints])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


TIE = ("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")


def code_of(key: Column) -> Column:
    """A supplier's key as a code with an exchange."""
    exchange = F.when(key % 3 == 0, ".SH").when(key % 3 == 1, ".SZ").otherwise(".BJ")
    return F.concat(F.format_string("%06d", key), exchange)


CODE = "printf('%06d', {k}) || CASE {k} % 3 WHEN 0 THEN '.SH' WHEN 1 THEN '.SZ' ELSE '.BJ' END"


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as trades of their supplier."""
    t = table(spark, sf_dir, "lineitem")
    return t.select(
        code_of(F.col("l_suppkey")).alias("entity_code"), F.col("l_shipdate").alias("trade_time"), *TIE,
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_quantity").alias("volume"), F.col("l_extendedprice").alias("amount"),
    )


def bars(spark: SparkSession, sf_dir: str, deal: bool = False, only: tuple[str, ...] = ()) -> DataFrame:
    """only: the prices and sums that are needed, for bars that are stored; what is left out is not shuffled either."""

    def make() -> DataFrame:
        made = source.bars(trades(spark, sf_dir), tie=TIE, deal=deal)
        return made.select("entity_code", "trade_date", *only) if only else made

    return once("bars", make)


def entity_number() -> Column:
    return F.substring_index("entity_code", ".", 1).cast("long")


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly bars with the fields that factors need; all but the bars follow from the entity's number by rule."""
    return once("panel", lambda: _panel(spark, sf_dir))


def _panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = Window.partitionBy("entity_code").orderBy("trade_date")
    k = entity_number()
    b = bars(spark, sf_dir).withColumn("pre_close", F.lag("close").over(own)).withColumn("nth", F.row_number().over(own))
    return b.select(
        "*",
        ((F.col("close") / F.col("pre_close") - 1) * 100).alias("pct_chg"),
        (F.col("volume") / (500 + 10 * (k % 50))).alias("turnover_rate"),
        (F.col("close") / (1 + k % 7)).alias("pe"),
        (F.col("close") / (1000 + 100 * (k % 11))).alias("pb"),
        (F.col("pre_close") * 1.1).alias("high_limited"),
        (F.col("pre_close") * 0.9).alias("low_limited"),
        (k % 17 == 0).cast("int").alias("is_st"),
        ((k + F.col("nth")) % 23 == 0).cast("int").alias("is_susp"),
        (k % 29 == 0).cast("int").alias("is_wd"),
    )


_ORDER = "l_shipdate, l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice"
BARS = f"""
t AS (SELECT *, {CODE.format(k="l_suppkey")} AS entity_code, date_trunc('week', l_shipdate)::DATE AS trade_date, l_extendedprice / l_quantity AS price FROM lineitem),
bars AS (SELECT entity_code, trade_date, first(price ORDER BY {_ORDER}) AS open, max(price) AS high, min(price) AS low, last(price ORDER BY {_ORDER}) AS close,
  sum(l_quantity) AS volume, sum(l_extendedprice) AS amount FROM t GROUP BY ALL)"""
PANEL = f"""{BARS},
p0 AS (SELECT *, lag(close) OVER o AS pre_close, row_number() OVER o AS nth, split_part(entity_code, '.', 1)::BIGINT AS k FROM bars WINDOW o AS (PARTITION BY entity_code ORDER BY trade_date)),
panel AS (SELECT *, (close / pre_close - 1) * 100 AS pct_chg, volume / (500 + 10 * (k % 50)) AS turnover_rate, close / (1 + k % 7) AS pe, close / (1000 + 100 * (k % 11)) AS pb,
  pre_close * 1.1 AS high_limited, pre_close * 0.9 AS low_limited, (k % 17 = 0)::INT AS is_st, ((k + nth) % 23 = 0)::INT AS is_susp, (k % 29 = 0)::INT AS is_wd FROM p0)"""


#: Number prefixes of codes on different boards, by the entity's number.
PREFIXES = ("600", "688", "300", "430", "003", "900", "001")


def coded() -> Column:
    """The entity's code with a number of some board."""
    k = entity_number()
    prefix = F.element_at(F.array(*map(F.lit, PREFIXES)), (k % len(PREFIXES) + 1).cast("int"))
    return F.concat(prefix, F.format_string("%03d", k), F.lit("."), F.substring_index("entity_code", ".", -1))


CODED = f"[{', '.join(f"'{p}'" for p in PREFIXES)}][split_part(entity_code, '.', 1)::BIGINT % {len(PREFIXES)} + 1] || printf('%03d', split_part(entity_code, '.', 1)::BIGINT) || '.' || split_part(entity_code, '.', 2)"


def over(n: int) -> str:
    return f"(PARTITION BY entity_code ORDER BY trade_date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


ROWS = "(PARTITION BY entity_code ORDER BY trade_date)"
