"""Scores of many models side by side: one row per date and entity with a column per model.

Pairs are never joined with each other. A date's columns are ranked once for all pairs that share their missing entities, and
the products of all ranks are one matrix; ensembles are weights on the columns.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .metrics import metrics

DAY = "trade_date"


def side_by_side(long: DataFrame, key: str = "model_id", value: str = "score", names: list[str] | None = None) -> tuple[DataFrame, list[str]]:
    """long (trade_date, entity_code, key, value) -> (wide, names): a column m0, m1, ... per key, in the order of names.

    The keys, sorted unless given, are few (models, features). Of rows that repeat each other the largest value counts.
    """
    names = names or sorted(r[0] for r in long.select(key).where(F.col(key).isNotNull()).distinct().collect())
    wide = long.groupBy(DAY, "entity_code").pivot(key, names).agg(F.max(value)) if names else long.select(DAY, "entity_code").distinct()
    return wide.select(DAY, "entity_code", *[F.col(f"`{n}`").cast("double").alias(f"m{i}") for i, n in enumerate(names)]), names


def mean_ranks(v: np.ndarray) -> np.ndarray:
    """Ranks from 1 of each column, ties with their mean."""
    out = np.empty(v.shape)
    for j in range(v.shape[1]):
        _, of, n = np.unique(v[:, j], return_inverse=True, return_counts=True)
        out[:, j] = (np.cumsum(n) - (n - 1) / 2)[of]
    return out


def rank_correlations(v: np.ndarray) -> np.ndarray:
    """v with NaN for what is missing -> the Spearman matrix over the rows that both columns have; NaN where one is constant,
    infinite where no row has both."""
    k = v.shape[1]
    out, there = np.full((k, k), np.inf), ~np.isnan(v)
    _, first, kind = np.unique(there, axis=1, return_index=True, return_inverse=True)
    groups = [np.flatnonzero(kind.ravel() == g) for g in range(len(first))]
    for a, own in enumerate(groups):
        for other in groups[a:]:
            rows = there[:, own[0]] & there[:, other[0]]
            if not rows.any():
                continue
            left, right = (mean_ranks(v[np.ix_(rows, c)]) for c in (own, other))
            left, right = left - left.mean(0), right - right.mean(0)
            with np.errstate(all="ignore"):
                r = (left.T @ right) / np.sqrt((left**2).sum(0)[:, None] * (right**2).sum(0)[None, :])
            r = np.where(np.isfinite(r), r, np.nan)
            out[np.ix_(own, other)], out[np.ix_(other, own)] = r, r.T
    return out


def _daily(k: int, least: int):
    def run(key: tuple, group: pa.Table) -> pa.Table:
        v = np.column_stack([group.column(f"m{i}").to_numpy() for i in range(k)]).astype(float)
        v[:, (~np.isnan(v)).sum(0) < least] = np.nan
        r = rank_correlations(v)
        a, b = np.triu_indices(k, 1)
        met = ~np.isinf(r[a, b])
        a, b = a[met], b[met]
        return pa.table({"a": pa.array(a, pa.int32()), "b": pa.array(b, pa.int32()), "rho": pa.array(r[a, b], pa.float64(), from_pandas=True)})

    return run


def wide_correlations(wide: DataFrame, names: list[str], least: int = 1) -> DataFrame:
    """wide (trade_date, names...), a row per date and entity -> (a, b, days, rho) as pair_correlations."""
    k = len(names)
    columns = wide.select(DAY, *[F.col(n).cast("double").alias(f"m{i}") for i, n in enumerate(names)])
    daily = columns.groupBy(DAY).applyInArrow(_daily(k, least), "a int, b int, rho double")
    pairs = daily.groupBy("a", "b").agg(F.count("rho").alias("days"), F.avg("rho").alias("rho"))
    name = lambda c: F.element_at(F.array(*map(F.lit, names)), F.col(c) + 1).alias(c)
    return pairs.select(name("a"), name("b"), "days", "rho") if names else pairs.select(F.lit("").alias("a"), F.lit("").alias("b"), "days", "rho")


def pair_correlations(long: DataFrame, key: str = "model_id", value: str = "score", least: int = 1, common: bool = False, names: list[str] | None = None) -> DataFrame:
    """long (trade_date, entity_code, key, value) -> (a, b, days, rho): mean daily Spearman of every pair, a before b.

    A column with fewer than `least` values on a date has none there. common: only entities that all columns have count, else
    those that both have. Days on which a side is constant do not count; pairs that never meet are not in the result.
    """
    wide, names = side_by_side(long, key, value, names)
    if common:
        wide = wide.dropna()
    places = wide_correlations(wide, [f"m{i}" for i in range(len(names))], least)
    name = lambda c: F.element_at(F.array(*map(F.lit, names)), F.substring(c, 2, 9).cast("int") + 1).alias(c)
    return places.select(name("a"), name("b"), "days", "rho") if names else places


def scenarios(weights: dict[str, float], shift: float = 0.1) -> list[tuple[str, str, list[float]]]:
    """(kind, source, weights in the order of sources) of an ensemble: as it is (base), each source alone, without it, and with
    its weight moved down and up by the shift while the others keep their proportions; two sources run from 0 to 1 in quarters.
    """
    names, total = list(weights), sum(weights.values())
    base = np.array([w / total for w in weights.values()])
    out = [("base", "", base)]
    for i, n in enumerate(names):
        one = np.eye(len(names))[i]
        rest = base * (1 - one)
        rest = rest / rest.sum() if rest.sum() > 0 else (1 - one) / max(1, len(names) - 1)
        out += [("alone", n, one), ("without", n, rest)]
        if len(names) != 2:
            for kind, step in (("less", -shift), ("more", shift)):
                own = min(1.0, max(0.0, base[i] + step))
                out.append((kind, n, own * one + (1 - own) * rest))
    if len(names) == 2:
        out += [("quarters", f"{q}/4", np.array([q / 4, 1 - q / 4])) for q in range(5)]
    return [(k, n, w.tolist()) for k, n, w in out]


def scenario_scores(common: DataFrame, plans: list[tuple[str, str, list[float]]]) -> DataFrame:
    """common (trade_date, entity_code, label, m0, m1, ...) without gaps -> (kind, source, trade_date, label, prediction).

    The prediction is the place of the weighted score among the date's entities, from -1 to 1, ties by entity.
    """
    raw = lambda w: F.round(sum((F.lit(v) * F.col(f"m{i}") for i, v in enumerate(w)), F.lit(0.0)), 12)
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(n).alias("source"), raw(w).alias("raw")) for k, n, w in plans]))
    long = common.select(DAY, "entity_code", "label", each.alias("s")).select(DAY, "entity_code", "label", "s.*")
    own = Window.partitionBy("kind", "source", DAY)
    place, n = F.row_number().over(own.orderBy("raw", F.col("entity_code").desc())), F.count(F.lit(1)).over(own)
    return long.withColumns({"__place": place, "__n": n}).select("kind", "source", DAY, "entity_code", "label", F.when(F.col("__n") > 1, 2 * (F.col("__place") - 1) / (F.col("__n") - 1) - 1).otherwise(0.0).alias("prediction"))


def common_rows(long: DataFrame, labels: DataFrame, names: list[str]) -> DataFrame:
    """Entities and dates that all models score and that have a label: (trade_date, entity_code, label, m0, m1, ...)."""
    wide, _ = side_by_side(long, names=names)
    return wide.dropna().join(labels.where("label is not null").select(DAY, "entity_code", "label"), [DAY, "entity_code"])


def ensemble_report(common: DataFrame, weights: dict[str, float], shift: float = 0.1) -> DataFrame:
    """(kind, source, rows, days, rmse, ic, icir, delta) of every scenario; delta: its mean daily IC less that of base."""
    m = metrics(scenario_scores(common, scenarios(weights, shift)), ["kind", "source"])
    base = F.max(F.when(F.col("kind") == "base", F.col("ic"))).over(Window.partitionBy())  # a row per scenario
    return m.withColumn("delta", F.col("ic") - base).select("kind", "source", "rows", "days", "rmse", "ic", "icir", "delta")


def even_windows(dates: DataFrame, days: int = 20, most: int = 8) -> DataFrame:
    """dates (trade_date) -> (trade_date, part): consecutive parts of about so many dates, from 1; first ones take the rest."""
    order, n = Window.orderBy(DAY), F.count(F.lit(1)).over(Window.partitionBy())  # a row per date
    i, parts = F.row_number().over(order) - 1, F.least(F.lit(most), F.greatest(F.lit(1), F.ceil(F.col("n") / days)))
    d = dates.select(DAY).distinct().withColumns({"i": i, "n": n}).withColumn("parts", parts)
    size, rest = F.floor(F.col("n") / F.col("parts")), F.col("n") % F.col("parts")
    edge = rest * (size + 1)
    part = F.when(F.col("i") < edge, F.floor(F.col("i") / (size + 1))).otherwise(rest + F.floor((F.col("i") - edge) / size)) + 1
    return d.select(DAY, part.cast("int").alias("part"))


def ensemble_windows(common: DataFrame, weights: dict[str, float], days: int = 20, most: int = 8) -> DataFrame:
    """(part, kind, source, days, ic, icir, best): base and each source alone over windows of about `days` dates; best marks
    the source of the highest mean IC in a window, ties to the first."""
    plans = [p for p in scenarios(weights) if p[0] in ("base", "alone")]
    scores = scenario_scores(common, plans).join(F.broadcast(even_windows(common, days, most)), DAY)  # a row per date
    m = metrics(scores, ["part", "kind", "source"])
    first = F.row_number().over(Window.partitionBy("part", "kind").orderBy(F.col("ic").desc_nulls_last(), "source")) == 1
    return m.withColumn("best", F.when(F.col("kind") == "alone", first.cast("int"))).select("part", "kind", "source", "days", "ic", "icir", "best")
