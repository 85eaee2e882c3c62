"""Rolling functions whose frames are long, nested or need two passes, over rows that Spark deals and sorts by entity.

Spark's sliding frames work out an aggregate anew for each row, value by value, and frames as arrays are built for each
row. Here a step per lag adds a whole batch of rows at once, so a row costs some nanoseconds per lag. Frames are the last
n rows of an entity, as in rolling. From batch to batch only the last rows of the entity at hand are kept.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .rolling import DAY, ENTITY


class Series:
    """Values of the rows of a batch, and which are known (not null)."""

    def __init__(self, v: np.ndarray, ok: np.ndarray):
        self.v, self.ok = np.where(ok, v, 0.0), ok

    def _with(self, other, make) -> Series:
        o = other if isinstance(other, Series) else Series(np.full(len(self.v), float(other)), np.ones(len(self.v), bool))
        return Series(make(self.v, o.v), self.ok & o.ok)

    def __add__(self, other):
        return self._with(other, np.add)

    def __sub__(self, other):
        return self._with(other, np.subtract)

    def __rsub__(self, other):
        return self._with(other, lambda a, b: b - a)

    def __mul__(self, other):
        return self._with(other, np.multiply)

    __radd__, __rmul__ = __add__, __mul__

    def __truediv__(self, other):
        """Null where the divisor is 0."""
        out = self._with(other, np.divide)
        return out if not isinstance(other, Series) else Series(out.v, out.ok & (other.v != 0))

    def __rtruediv__(self, other):
        return Series(np.divide(float(other), self.v), self.ok & (self.v != 0))

    def __abs__(self) -> Series:
        return Series(np.abs(self.v), self.ok)

    def at_least(self, bound) -> Series:
        return self._with(bound, np.maximum)

    def at_most(self, bound) -> Series:
        return self._with(bound, np.minimum)

    def log(self) -> Series:
        return Series(np.log(self.v), self.ok & ~(self.v <= 0))

    def sqrt(self) -> Series:
        return Series(np.sqrt(self.v), self.ok)


#: Lengths of frames at which running totals are kept on the way to longer ones.
KEPT = (3, 5, 6, 10, 12, 14, 15, 20, 21, 24, 26, 60, 61, 63, 120, 240, 250, 252)


class Rows:
    """The columns of a batch's rows, sorted by entity and day, and each row's place within its entity.

    What factors share (series by name, totals and moments of one series) is worked out once per batch.
    """

    def __init__(self, get: Callable[[str], Series], place: np.ndarray):
        self.get, self.place = get, place
        self.most = int(place.max()) + 1 if len(place) else 0
        self.named: dict[str, Series] = {}
        self.totals: dict[int, tuple[Series, dict[int, tuple[np.ndarray, np.ndarray]]]] = {}
        self.central: dict[tuple[int, int], tuple] = {}

    def __getitem__(self, name: str) -> Series:
        return self.get(name)

    def once(self, name: str, make: Callable[[Rows], Series]) -> Series:
        if name not in self.named:
            self.named[name] = make(self)
        return self.named[name]

    def lags(self, x: Series, n: int, start: int = 0):
        """(lag, rows that have it, values, known) of each row that far back."""
        for k in range(start, min(n, self.most)):
            yield k, slice(k, None), x.v[: len(x.v) - k], x.ok[: len(x.v) - k] & (self.place[k:] >= k)

    def ref(self, x: Series, k: int) -> Series:
        v, ok = np.zeros(len(x.v)), np.zeros(len(x.v), bool)
        if k < len(v):
            v[k:], ok[k:] = x.v[: len(v) - k], x.ok[: len(v) - k] & (self.place[k:] >= k)
        return Series(v, ok)

    def period_return(self, x: Series, k: int) -> Series:
        return x / self.ref(x, k) - 1

    def _total(self, x: Series, n: int, weights=None) -> tuple[np.ndarray, np.ndarray]:
        if weights is None:
            return self._plain(x, n)
        top, low = np.zeros(len(x.v)), np.zeros(len(x.v))
        for k, to, v, ok in self.lags(x, n):
            top[to] += np.where(ok, v * weights[k], 0.0)
            low[to] += ok * weights[k]
        return top, low

    def _plain(self, x: Series, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Sum and count of the frame; longer frames go on from shorter ones of the same series."""
        _, kept = self.totals.setdefault(id(x), (x, {}))  # x is held, so that its id stays its own
        if n not in kept:
            start = max((m for m in kept if m < n), default=0)
            top, low = (a.copy() for a in kept[start]) if start else (np.zeros(len(x.v)), np.zeros(len(x.v)))
            for k, to, v, ok in self.lags(x, n, start):
                top[to] += np.where(ok, v, 0.0)
                low[to] += ok
                if k + 1 in KEPT and k + 1 not in kept:
                    kept[k + 1] = top.copy(), low.copy()
            kept[n] = top, low
        return kept[n]

    def sum(self, x: Series, n: int) -> Series:
        top, count = self._total(x, n)
        return Series(top, count > 0)

    def weighted(self, x: Series, n: int, weights=None) -> Series:
        """Mean of the frame under weights by lag, over the lags that have a value."""
        top, low = self._total(x, n, weights)
        return Series(top / np.where(low == 0, 1.0, low), low != 0)

    mean = weighted

    def ema(self, x: Series, n: int) -> Series:
        alpha = 2 / (n + 1)
        return self.weighted(x, n, alpha * (1 - alpha) ** np.arange(n))

    def half_life(self, x: Series, n: int, days: float) -> Series:
        return self.weighted(x, n, 0.5 ** (np.arange(n) / days))

    def mad(self, x: Series, n: int) -> Series:
        """Mean absolute deviation from the frame's own mean."""
        centre, off = self.mean(x, n), np.zeros(len(x.v))
        for _, to, v, ok in self.lags(x, n):
            off[to] += np.where(ok, np.abs(v - centre.v[to]), 0.0)
        count = self._total(x, n)[1]
        return Series(off / np.maximum(count, 1), count > 0)

    def _central(self, x: Series, n: int, high: bool = False) -> tuple:
        """Count of the frame and the sums of its second, and if high of its third and fourth, powers about its mean."""
        if (found := self.central.get((id(x), n))) and (found[3] is not None or not high):
            return found[1:]
        at = np.arange(len(x.v))
        known = np.maximum.accumulate(np.where(x.ok, at, -1))
        anchor = np.where(known >= at - self.place, x.v[np.maximum(known, 0)], 0.0)  # so that the mean of equal values is exactly theirs
        off, count = np.zeros(len(at)), np.zeros(len(at))
        for _, to, v, ok in self.lags(x, n):
            off[to] += np.where(ok, v - anchor[to], 0.0)
            count[to] += ok
        off /= np.maximum(count, 1)
        m2, m3, m4 = np.zeros(len(at)), np.zeros(len(at)) if high else None, np.zeros(len(at)) if high else None
        for _, to, v, ok in self.lags(x, n):
            d = np.where(ok, v - anchor[to] - off[to], 0.0)
            square = d * d
            m2[to] += square
            if high:
                m3[to] += square * d
                m4[to] += square * square
        self.central[id(x), n] = (x, count, m2, m3, m4)  # x is held, so that its id stays its own
        return count, m2, m3, m4

    def moment(self, x: Series, n: int, k: int) -> Series:
        """The k-th central moment of the frame over its sample variance to the power k / 2; null where it does not vary."""
        count, m2, m3, m4 = self._central(x, n, high=True)
        return Series((m3 if k == 3 else m4) / count / (m2 / (count - 1)) ** (k / 2), (count > 1) & (m2 != 0))

    def var(self, x: Series, n: int) -> Series:
        """Sample variance; one value has none."""
        count, m2, *_ = self._central(x, n)
        return Series(m2 / (count - 1), count > 1)

    def std(self, x: Series, n: int) -> Series:
        return self.var(x, n).sqrt()

    def slope(self, x: Series, n: int) -> Series:
        """Least squares over row numbers, nulls left out."""
        mean, back = self.mean(x, n), np.zeros(len(x.v))
        for k, to, _, ok in self.lags(x, n):
            back[to] += ok * float(k)
        count = self._total(x, n)[1]
        back /= np.maximum(count, 1)
        both, square = np.zeros(len(x.v)), np.zeros(len(x.v))
        for k, to, v, ok in self.lags(x, n):
            d = np.where(ok, back[to] - k, 0.0)
            both[to] += d * (v - mean.v[to])
            square[to] += d * d
        return Series(both / square, count > 1)

    def share_at_most(self, x: Series, n: int) -> Series:
        """Share of the frame's values that are at most the current one."""
        below = np.zeros(len(x.v))
        for _, to, v, ok in self.lags(x, n):
            below[to] += ok & (v <= x.v[to])
        return Series(below / np.maximum(self._total(x, n)[1], 1), x.ok)

    def place_of_most(self, x: Series, n: int) -> Series:
        """Values of the frame minus the place of the latest maximum, current row 1, plus 1."""
        most, place = np.zeros(len(x.v)), np.zeros(len(x.v))
        for k, to, v, ok in self.lags(x, n):
            more = ok & ((place[to] == 0) | (v > most[to]))
            most[to], place[to] = np.where(more, v, most[to]), np.where(more, k + 1, place[to])
        count = self._total(x, n)[1]
        return Series(count - place + 1, count > 0)


def _wide(batch: pa.RecordBatch, out: dict[str, Series], old: int) -> pa.RecordBatch:
    """The batch with all that was made."""
    cut = lambda s: pa.array(s.v[old:], pa.float64(), mask=~s.ok[old:])
    return pa.RecordBatch.from_arrays([*batch.columns, *map(cut, out.values())], names=[*batch.schema.names, *out])


def _narrow(day: str, kept: list[str]):
    """The day and the kept ones of each row; how many values of each one are finite stands in the batch's first row."""

    def give(batch: pa.RecordBatch, out: dict[str, Series], old: int) -> pa.RecordBatch:
        counts = [int(np.count_nonzero(s.ok[old:] & np.isfinite(s.v[old:]))) for s in out.values()]
        rows = _wide(batch.select([day]), {n: out[n] for n in kept}, old)
        return pa.RecordBatch.from_arrays([*rows.columns, pa.array([counts, *[None] * (batch.num_rows - 1)], pa.list_(pa.int64()))], names=[*rows.schema.names, "finite"])

    return give


def _pass(made: dict[str, Callable[[Rows], Series]], entity: str, back: int, give: Callable):
    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            new = pa.Table.from_batches([batch])
            table = new if held is None else pa.concat_tables([held, new])
            old = table.num_rows - new.num_rows
            codes = table.column(entity).combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            at = np.arange(len(codes))
            first = np.maximum.accumulate(np.where(np.concatenate([[True], codes[1:] != codes[:-1]]), at, 0))
            seen: dict[str, Series] = {}

            def get(name: str) -> Series:
                if name not in seen:  # noqa: B023
                    c = table.column(name)  # noqa: B023
                    seen[name] = Series(c.cast(pa.float64()).to_numpy(), ~c.is_null().to_numpy())  # noqa: B023
                return seen[name]  # noqa: B023

            with np.errstate(all="ignore"):
                rows = Rows(get, at - first)
                out = {n: f(rows) for n, f in made.items()}
            yield give(batch, out, old)
            held = table.slice(max(int(first[-1]), table.num_rows - back))

    return run


def with_lagged(df: DataFrame, made: dict[str, Callable[[Rows], Series]], back: int, entity: str = ENTITY, day: str = DAY) -> DataFrame:
    """df with a column of doubles per entry of made. back: as many rows as the longest chain of frames looks back."""
    if not made:
        return df
    schema = T.StructType([*df.schema.fields, *[T.StructField(n, T.DoubleType()) for n in made]])
    nullable = T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields])
    dealt = df.repartition(F.col(entity)).sortWithinPartitions(entity, day)
    return dealt.mapInArrow(_pass(made, entity, back, _wide), nullable)


def finite_lagged(df: DataFrame, made: dict[str, Callable[[Rows], Series]], back: int, kept: list[str], entity: str = ENTITY, day: str = DAY) -> DataFrame:
    """(day, kept..., finite): a row per row of df with the kept entries of made; finite, null in most rows, holds counts of
    finite values of all entries in their order, to be added up. What is only counted never leaves the pass."""
    schema = T.StructType([df.schema[day], *[T.StructField(n, T.DoubleType()) for n in kept], T.StructField("finite", T.ArrayType(T.LongType()))])
    nullable = T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields])
    dealt = df.repartition(F.col(entity)).sortWithinPartitions(entity, day)
    return dealt.mapInArrow(_pass(made, entity, back, _narrow(day, kept)), nullable)
