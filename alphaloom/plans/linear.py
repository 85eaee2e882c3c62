"""Linear models from additive blocks: one pass over the rows serves every window, label, penalty and left-out feature.

For each date and label the rows' products are summed into one matrix of (1, features, label). The rows of a window are
the sum of its dates' blocks, a feature is left out by leaving out its row and column, and what is solved on the driver has as
many equations as there are features.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.sinks import stored

#: Matrix entries that a task holds before it hands its partial sums on.
HELD = 4_000_000


@dataclass(frozen=True)
class Blocks:
    """table: (trade_date, label, n, sums) with sums the matrix of (1, features, label) by rows, each less its shift."""

    names: tuple[str, ...]
    labels: tuple[str, ...]
    shift: dict[str, float]
    table: DataFrame


_SUMS = "trade_date date, label string, n long, sums array<double>"


def _packed(found: dict) -> pa.RecordBatch:
    days, labels = zip(*found, strict=True)
    columns = [pa.array(days, pa.date32()), pa.array(labels, pa.string()), pa.array([round(m[0, 0]) for m in found.values()], pa.int64()), pa.array([m.ravel().tolist() for m in found.values()], pa.list_(pa.float64()))]
    return pa.RecordBatch.from_arrays(columns, names=["trade_date", "label", "n", "sums"])


def _partial(names: tuple[str, ...], labels: tuple[str, ...], shift: dict[str, float]):
    def run(batches):
        found: dict = {}
        size = (len(names) + 2) ** 2
        for batch in batches:
            if not batch.num_rows:
                continue
            get = lambda c: batch.column(c).to_numpy(zero_copy_only=False).astype(float) - shift[c]  # noqa: B023, E731
            x = np.column_stack([np.ones(batch.num_rows), *map(get, names)])
            days, of = np.unique(batch.column("trade_date").cast(pa.int32()).to_numpy(zero_copy_only=False), return_inverse=True)
            order = np.argsort(of, kind="stable")
            cut = np.searchsorted(of[order], np.arange(len(days) + 1))
            for label in labels:
                z = np.column_stack([x, get(label)])[order]
                for i, day in enumerate(days.tolist()):
                    own = z[cut[i] : cut[i + 1]]
                    own = own[np.isfinite(own).all(1)]
                    if len(own):
                        key = (day, label)
                        found[key] = found[key] + own.T @ own if key in found else own.T @ own
            if len(found) * size > HELD:
                yield _packed(found)
                found = {}
        if found:
            yield _packed(found)

    return run


def _added(key: tuple, group: pa.Table) -> pa.Table:
    values = np.array(group.column("sums").to_pylist()).sum(0)
    out = {f.name: pa.array([v.as_py()], f.type) for f, v in zip([group.schema.field(n) for n in group.column_names[: len(key)]], key, strict=True)}
    return pa.table(out | {"n": pa.array([sum(group.column("n").to_pylist())], pa.int64()), "sums": pa.array([values.tolist()], pa.list_(pa.float64()))})


def blocks(dataset: DataFrame, names: list[str], labels: list[str] | None = None) -> Blocks:
    """dataset (trade_date, names..., labels...) -> its blocks, stored. A row counts for a label if that and all features are
    finite. Rows of a date may be anywhere: partial sums of tasks are added by date."""
    labels = list(labels or ["label"])
    columns = [*names, *labels]
    rows = dataset.select(F.col("trade_date").cast("date").alias("trade_date"), *[F.col(c).cast("double").alias(c) for c in columns])
    finite = lambda c: F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.col(c))
    middle = rows.agg(*[F.coalesce(F.avg(finite(c)), F.lit(0.0)).alias(c) for c in columns]).first()  # keeps sums of products small
    shift = {c: float(middle[c]) for c in columns}
    partial = rows.mapInArrow(_partial(tuple(names), tuple(labels), shift), _SUMS)
    return Blocks(tuple(names), tuple(labels), shift, stored(partial.groupBy("trade_date", "label").applyInArrow(_added, _SUMS)))


def of_windows(own: Blocks, windows: DataFrame, split: str = "train") -> DataFrame:
    """windows (window, split, start_date, end_date) -> (window, label, n, sums) of one split, from its dates' blocks."""
    dates = windows.where(F.col("split") == split).select("window", F.explode(F.sequence("start_date", "end_date")).alias("trade_date"))
    met = own.table.join(dates, "trade_date").select("window", "label", "n", "sums")
    return met.groupBy("window", "label").applyInArrow(_added, "window int, label string, n long, sums array<double>")


def solve(sums: np.ndarray, penalty: float = 0.0, kept: list[int] | None = None) -> tuple[float, np.ndarray]:
    """(intercept, coefficients) of the shifted columns. penalty: on coefficients of standardised features and label, as
    Spark's linear regression has it. Features without variance, or left out, have coefficient 0."""
    n, p = sums[0, 0], len(sums) - 2
    mean = sums[0, 1:] / n
    cov = sums[1:, 1:] / n - np.outer(mean, mean)
    spread, out = np.sqrt(np.maximum(np.diagonal(cov), 0)), np.zeros(p)
    live = np.array([j for j in (range(p) if kept is None else kept) if spread[j] > 1e-12 * (1 + abs(mean[j]))], int)
    if len(live) and spread[-1] > 0:
        a = cov[np.ix_(live, live)] + np.diag(penalty / spread[-1] * spread[live] ** 2)
        out[live] = np.linalg.lstsq(a, cov[live, -1], rcond=None)[0]
    return float(mean[-1] - out @ mean[:-1]), out


def models(own: Blocks, windows: DataFrame, variants: list[dict]) -> DataFrame:
    """(window, label, variant, intercept, coefficients): variants (numbered from 1) may hold regParam and without, a list
    of names. One small system per row, solved on the driver; all of them come from the same blocks."""
    rows, p = [], len(own.names)
    shift = np.array([own.shift[n] for n in own.names])
    for r in of_windows(own, windows).collect():  # a matrix per window and label
        sums = np.array(r["sums"]).reshape(p + 2, p + 2)
        for i, v in enumerate(variants, 1):
            kept = [j for j, n in enumerate(own.names) if n not in v.get("without", ())]
            intercept, slopes = solve(sums, v.get("regParam", 0.0), kept)
            rows.append((r["window"], r["label"], i, float(intercept + own.shift[r["label"]] - slopes @ shift), slopes.tolist()))
    return own.table.sparkSession.createDataFrame(rows, "window int, label string, variant int, intercept double, coefficients array<double>")


def predicted(names: list[str], intercept: Column, coefficients: Column) -> Column:
    out = intercept
    for i, n in enumerate(names):
        out = out + coefficients[i] * F.col(n)
    return out
