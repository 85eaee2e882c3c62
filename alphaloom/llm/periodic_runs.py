"""Periodic runs: stretches of words that repeat with a period, none of which can be extended.

Periods are solved by octaves [P, 2P). For each scale a document is cut into overlapping tiles that are longer than its
periods, so a long document is many rows; a tile is solved by itself. Within a tile, blocks of a fixed grid are compared with
the blocks one period further on for all periods of the octave at once; around the blocks that recur, the Z-functions of
both boundaries say how far the period goes on. What a tile finds are fragments of runs: they meet by document and
period, and those that overlap in a whole period are stitched. Of the periods of one stretch the smallest is its own.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import mix64, reach_before, release, row_key, stored, table, text_batches, unused


@dataclass(frozen=True)
class Tiles:
    """least: words in a run. tile: words in the smallest tiles (a power of two), which serve periods below tile / 16; each
    further octave has tiles twice as long. Tiles overlap by three of their largest periods, so of every run the pieces of a
    period and more join. chunk: words solved at once. broadcast: runs (some 200 bytes each) that are sent to all executors at most.
    """

    least: int = 12
    tile: int = 8192
    chunk: int = 200_000
    broadcast: int = 250_000

    def most_period(self, scale: Column) -> Column:
        """Above the periods of a scale's tiles."""
        return _doubled(self.tile // 16, scale)

    def overlap(self, scale: Column) -> Column:
        return _doubled(3 * self.tile // 16, scale)


def _doubled(x: int, times: Column) -> Column:
    return F.call_function("shiftleft", F.lit(x), times)


def words_of(text: Column) -> Column:
    """Words between space, tab, line feed, vertical tab, form feed and carriage return. Null has none."""
    return F.array_remove(F.split(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+"), "")


def tiles(rows: DataFrame, spec: Tiles) -> DataFrame:
    """rows (key, words) -> (key, start, low, high, words): what to solve, for periods in [low, high).

    The last scale is the one that holds the whole document in one tile; its periods have no upper bound.
    """
    n, scale = F.size("words"), F.col("scale")
    last = F.when(n <= spec.tile, 0).otherwise(F.length(F.bin(F.floor((n - 1) / spec.tile))))
    scales = F.when(n >= spec.least, F.sequence(F.lit(0), last))  # not a filter: that would be evaluated below the words, and cut texts twice
    scaled = rows.select("key", "words", last.alias("last"), F.explode(scales).alias("scale"))
    size, overlap, whole = _doubled(spec.tile, scale), spec.overlap(scale), scale == F.col("last")
    starts = F.when(whole, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), n - overlap - 1, size - overlap))
    placed = scaled.select("key", "words", "scale", "last", F.explode(starts).alias("start"))
    low = F.when(scale == 0, 1).otherwise(_doubled(spec.tile // 32, scale))
    high = F.when(whole, 2**30).otherwise(spec.most_period(scale))
    return placed.select("key", "start", low.alias("low"), high.alias("high"), F.slice("words", F.col("start") + 1, F.when(whole, n).otherwise(size)).alias("words"))


_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))


class Prints:
    """Fingerprints of all blocks of a sequence of whole numbers: polynomial sums modulo 2**64 of their mixed values."""

    def __init__(self, x: np.ndarray):
        self.n = len(x)
        self.sums, self.back = np.zeros(self.n + 1, np.uint64), np.ones(self.n + 1, np.uint64)
        power = np.full(self.n, _BASE)
        np.multiply.accumulate(power, out=power)
        np.cumsum(mix64(x.astype(np.uint64) + np.uint64(1)) * power, out=self.sums[1:])
        self.back[1:] = _BACK
        np.multiply.accumulate(self.back, out=self.back)

    def grid(self, size: int, n: int) -> np.ndarray:
        """Of the blocks of one size at all places of the first n."""
        return (self.sums[size : n + 1] - self.sums[: n + 1 - size]) * self.back[: n + 1 - size]

    def at(self, place: np.ndarray, size: int) -> np.ndarray:
        return (self.sums[place + size] - self.sums[place]) * self.back[place]

    def ahead(self, place: np.ndarray, shift: np.ndarray, below: int, n: int) -> np.ndarray:
        """The Z-function of the sequence from a boundary on, at a shift: words that agree with those one shift further.

        below: a power of two that the value stays under.
        """
        at = place.copy()
        while below > 1:
            below //= 2
            inside = at + shift + below <= n
            p = np.where(inside, at, 0)
            at += below * (inside & (self.at(p, below) == self.at(np.where(inside, p + shift, 0), below)))
        return at - place

    def behind(self, place: np.ndarray, shift: np.ndarray, below: int) -> np.ndarray:
        """The same of the sequence read backwards from the boundary."""
        at = place.copy()
        while below > 1:
            below //= 2
            inside = at >= below
            p = np.where(inside, at - below, 0)
            at -= below * (inside & (self.at(p, below) == self.at(p + np.where(inside, shift, 0), below)))
        return place - at


def block(period: int, least: int) -> int:
    """Of the grid of an octave: every stretch of equal words of one of its runs holds a whole block of that size."""
    stretch = min(max(q, least - q) for q in range(period, min(2 * period, max(period, least) + 1)))
    size = 1
    while 4 * size - 1 <= stretch:
        size *= 2
    return size


def octave(prints: Prints, n: int, period: int, least: int) -> np.ndarray:
    """(period, start, end) of the stretches [start, end) of the first n words whose words recur one period further, for
    periods in [period, 2 * period), where they are long enough for a run: a period, and least words with it."""
    size = block(period, least)
    grid = prints.grid(size, n)
    padded = np.concatenate([grid, np.zeros(2 * period, np.uint64)])
    own = grid[::size]
    later = np.lib.stride_tricks.sliding_window_view(padded, period)[period::size][: len(own)]
    c, shift = np.nonzero(later == own[: len(later), None])
    c, q = c * size, shift + period
    inside = c + q + size <= n
    c, q = c[inside], q[inside]
    if not len(c):
        return np.empty((0, 3), np.int64)
    order = np.lexsort((c, q))
    c, q = c[order], q[order]
    first = np.concatenate([[True], (np.diff(q) != 0) | (np.diff(c) != size)])
    last = np.concatenate([first[1:], [True]])
    a, b, q = c[first], c[last] + size, q[first]
    a, b = a - prints.behind(a, q, size), b + prints.ahead(b, q, size, n)
    keep = b - a >= np.maximum(q, least - q)
    return np.column_stack([q, a, b])[keep]


def plainly(x: np.ndarray, low: int, high: int, least: int) -> np.ndarray:
    """What octave() gives for all periods in [low, high), by comparing all words for each."""
    out = []
    for q in range(low, min(high, len(x) // 2 + 1)):
        edge = np.flatnonzero(np.diff(np.concatenate([[0], (x[:-q] == x[q:]).view(np.int8), [0]])))
        a, b = edge[::2], edge[1::2]
        keep = b - a >= max(q, least - q)
        out.append(np.column_stack([np.full(keep.sum(), q), a[keep], b[keep]]))
    return np.concatenate(out) if out else np.empty((0, 3), np.int64)


def _smallest(found: np.ndarray) -> np.ndarray:
    """(period, start, end): of stretches that are one stretch of words, the one of the smallest period."""
    q, a, b = found.T
    order = np.lexsort((q, b + q, a))
    q, a, b = q[order], a[order], b[order]
    return np.column_stack([q, a, b])[np.concatenate([[True], (np.diff(a) != 0) | (np.diff(b + q) != 0)])] if len(q) else found


def solve(parts: list[np.ndarray], low: int, high: int, least: int) -> list[np.ndarray]:
    """Of each sequence of whole numbers (not negative): (period, start, end) of its stretches, for periods in [low, high).

    The sequences are solved as one, longest first, with numbers of their own between them, so that an octave looks only at
    those that can hold it. Fingerprints are checked word by word.
    """
    order = sorted(range(len(parts)), key=lambda i: -len(parts[i]))
    top = max((int(p.max()) for p in parts if len(p)), default=0)
    size = np.array([len(parts[i]) + 1 for i in order])
    begin = np.concatenate([[0], np.cumsum(size)])
    x = np.concatenate([piece for k, i in enumerate(order) for piece in (parts[i], [top + 1 + k])]).astype(np.int64)
    prints, found, period = Prints(x), [], low
    while period < high:
        n = int(begin[np.searchsorted(-size, -(max(2 * period, least) + 1), side="right")])
        if not n:
            break
        found.append(octave(prints, n, period, least))
        period *= 2
    all_ = _smallest(np.concatenate(found)) if found else np.empty((0, 3), np.int64)
    where = np.searchsorted(begin, all_[:, 1], side="right") - 1
    wrong = {int(where[i]) for i, (q, a, b) in enumerate(all_.tolist()) if not np.array_equal(x[a:b], x[a + q : b + q])}
    out: list[np.ndarray] = [np.empty((0, 3), np.int64)] * len(parts)
    by = np.argsort(where, kind="stable")
    cut = np.searchsorted(where[by], np.arange(len(parts) + 1))
    for k, i in enumerate(order):
        own = all_[by[cut[k] : cut[k + 1]]] - np.array([0, begin[k], begin[k]])
        out[i] = _smallest(plainly(parts[i].astype(np.int64), low, high, least)) if k in wrong else own
    return out


FOUND = pa.schema([("key", pa.string()), ("period", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])


def _solver(spec: Tiles):
    def run(batches):
        release()
        for batch in batches:
            lists = batch.column("words")
            code = lists.flatten().dictionary_encode().indices.to_numpy(zero_copy_only=False)
            cut = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(np.int64)
            start, low, high = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("start", "low", "high"))
            rows, at, stretches = np.lexsort((low, high)), [], []
            begin = 0
            while begin < len(rows):
                end, words = begin, 0
                same = lambda r, first=rows[begin]: low[r] == low[first] and high[r] == high[first]
                while end < len(rows) and same(rows[end]) and (words < spec.chunk or end == begin):
                    words += cut[rows[end] + 1] - cut[rows[end]]
                    end += 1
                chunk = rows[begin:end]
                for r, own in zip(chunk, solve([code[cut[r] : cut[r + 1]] for r in chunk], int(low[chunk[0]]), int(high[chunk[0]]), spec.least), strict=True):
                    at += [r] * len(own)
                    stretches.append(own + np.array([0, start[r], start[r]]))
                begin = end
            if at:
                q, a, b = np.concatenate(stretches).T
                yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(at)).cast(pa.string()), pa.array(q), pa.array(a), pa.array(b + q)], schema=FOUND)

    return run


def runs(rows: DataFrame, spec: Tiles = Tiles()) -> DataFrame:
    """rows (key string, words array<string>) -> (key, start, length, period) of every run: at least spec.least words and
    two periods, period the smallest one, start the number of its first word.

    Rows of fewer words, and null words, have no runs. Rows that repeat key and words count once; a key should have one
    sequence of words. Words are compared as they are; ties need no rule, as a stretch has one smallest period.
    """
    text_batches(rows.sparkSession)
    found = tiles(rows.select("key", F.col("words").cast("array<string>").alias("words")), spec).mapInArrow(_solver(spec), "key string, period long, start long, end long")
    own = Window.partitionBy("key", "period").orderBy("start", "end")
    reach = F.max("end").over(own.rowsBetween(Window.unboundedPreceding, -1))
    # Fragments are one run if they share a whole period of words.
    marked = found.withColumn("reach", reach).withColumn("new", F.coalesce((F.col("start") > F.col("reach") - F.col("period")).cast("int"), F.lit(1)))
    stitched = marked.withColumn("run", F.sum("new").over(own.rowsBetween(Window.unboundedPreceding, 0))).groupBy("key", "period", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return stitched.groupBy("key", "start", "end").agg(F.min("period").alias("period")).select("key", "start", (F.col("end") - F.col("start")).alias("length"), "period")


def summary(found: DataFrame) -> DataFrame:
    """Per key: n_runs, longest (length, start, period), runs in order, and what is left once every run is cut to its first
    period: kept (from, words) before repeated words, and rest, from where all is kept."""
    drop, to = F.col("start") + F.col("period"), F.col("start") + F.col("length")
    cut = found.withColumns({"drop": drop, "to": to}).withColumn("from", F.coalesce(reach_before("key", "drop", "to"), F.lit(0)))
    longest = F.min(F.struct((-F.col("length")).alias("less"), "start", "period"))
    return cut.groupBy("key").agg(
        F.count("*").alias("n_runs"), longest.alias("longest"), F.array_sort(F.collect_list(F.struct("start", "period", "length"))).alias("runs"),
        F.array_sort(F.collect_list(F.when(F.col("drop") > F.col("from"), F.struct("from", (F.col("drop") - F.col("from")).alias("words"))))).alias("kept"), F.max("to").alias("rest"),
    )


def with_summary(rows: DataFrame, spec: Tiles = Tiles(), name: str = "__runs") -> DataFrame:
    """rows (key, words, ...) with summary() as a struct column, null where there are no runs; rows stay as many as they are.

    What was found is broadcast up to spec.broadcast runs; beyond that both sides are shuffled.
    """
    found = stored(summary(runs(rows.select("key", "words"), spec)))
    few = (found.select(F.sum("n_runs")).first()[0] or 0) <= spec.broadcast
    packed = found.select(F.col("key").alias(f"{name}_key"), F.struct("n_runs", "longest", "runs", "kept", "rest").alias(name))
    return rows.join(F.broadcast(packed) if few else packed, F.col("key") == F.col(f"{name}_key"), "left").drop(f"{name}_key")


def kept_words(words: Column, found: Column) -> Column:
    """Words outside what repeats: of every run only its first period stays."""
    part = F.transform(found["kept"], lambda k: F.slice(words, k["from"].cast("int") + 1, k["words"].cast("int")))
    rest = F.slice(words, found["rest"].cast("int") + 1, F.greatest(F.size(words), F.lit(1)))
    return F.when(found.isNull(), words).otherwise(F.concat(F.flatten(part), rest))


def collapse(docs: DataFrame, spec: Tiles = Tiles(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs, the texts of those with runs being their kept words joined by one space; all other rows and columns stay.

    Null and empty texts stay. Columns of docs may have any names.
    """
    name = unused(docs, "__runs")
    own = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), row_key(docs[doc_id], docs[text]).alias("key"), words_of(docs[text]).alias("words"))
    met = with_summary(own, spec, name)
    new = F.when(F.col(name).isNull(), F.col("row")[text]).otherwise(F.array_join(kept_words(F.col("words"), F.col(name)), " "))
    return met.select(*[new.alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns])


def planted(doc_id: Column, words: Column) -> Column:
    """The words of the contract: of ids whose crc32 ends in 0, what follows a place repeats with a period of its own."""
    h, n = F.crc32(doc_id.cast("string").cast("binary")), F.size(words)
    g = F.floor(h / 10)
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    repeated = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(words, F.when(i < a, i).otherwise(a + (i - a) % p)))
    return F.when(F.coalesce(h % 10 == 0, F.lit(False)) & (n > 0), repeated).otherwise(words)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    cut = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key(docs["doc_id"], docs["text"]).alias("key"), words_of(docs["text"]).alias("words"))
    met, found = with_summary(cut.withColumn("words", planted(F.col("doc_id"), F.col("words")))), F.col("__runs")
    line = lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))
    length, period = -found["longest"]["less"], found["longest"]["period"]
    return met.select(
        "doc_id", F.coalesce(found["n_runs"], F.lit(0)).cast("long").alias("n_runs"), found["longest"]["start"].alias("start"), length.alias("length"), period.alias("period"),
        F.floor(1000 * length / period).cast("long").alias("exponent_milli"),
        F.sha2(F.coalesce(F.array_join(F.transform(found["runs"], line), ""), F.lit("")), 256).alias("runs_sha256"),
        F.sha2(F.array_join(kept_words(F.col("words"), found), " "), 256).alias("collapsed_sha256"),
    )
