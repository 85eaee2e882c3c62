"""Vector search over a table of embeddings: exact top-k by branch-and-bound, approximate by an adaptive dimension scan.

Both deal candidates and queries into a grid of bounded cells: a cell holds at most about `rows` candidates and
`queries` queries, whatever one list or one vector repeated a million times may hold. A cell returns the k best of each
of its queries, and the k best of these are taken by a ranking of k rows per query and cell.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table


@dataclass(frozen=True)
class Cells:
    rows: int = 8192
    queries: int = 1024
    dims: int = 16


@dataclass(frozen=True)
class Lists:
    """lists: inverted lists. sample: rows that fit centroids and probes, at most. recall: what probes aim at there.

    doubt: how many deviations a partial distance must lie outside to be given up.
    """

    lists: int = 64
    sample: int = 8192
    recall: float = 0.97
    rounds: int = 8
    doubt: float = 2.6
    seed: int = 7


def usable(df: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(id long, v array<double>, place long): rows whose id is not null and whose vector has only finite components.

    Written to the shared scratch folder, so that a row's place is the same wherever it is read.
    """
    v = df[vector_column]
    whole = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = df.where(whole & df[id_column].isNotNull())
    return stored(kept.select(df[id_column].cast("long").alias("id"), v.cast("array<double>").alias("v"), F.monotonically_increasing_id().alias("place")))


def _deal(place: Column, parts: Column) -> Column:
    """A part from 0 to parts - 1 by the row's place, so repeated ids and vectors spread too."""
    return F.pmod(F.xxhash64(place), parts).cast("int")


def _matrix(part: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """dimension -> (ids, vectors, places)."""
    ids, place = part.column("id").to_numpy(), part.column("place").to_numpy()
    lists = part.column("v").combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.chunk(0) if lists.num_chunks else pa.array([], pa.list_(pa.float64()))
    size = np.diff(lists.offsets.to_numpy()) if len(lists) else np.empty(0, int)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    start = np.concatenate([[0], np.cumsum(size)[:-1]]).astype(int) if len(size) else size
    out = {}
    for d in np.unique(size):
        rows = np.flatnonzero(size == d)
        order = np.argsort(place[rows], kind="stable")
        rows = rows[order]
        out[int(d)] = (ids[rows], flat[start[rows][:, None] + np.arange(d)], place[rows])
    return out


def _top(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, ties to the smaller id."""
    if len(scores) > k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= edge)
    else:
        near = np.arange(len(scores))
    return near[np.lexsort((ids[near], -scores[near]))][:k]


def _answer(rows: list[tuple[np.ndarray, ...]], kind: pa.DataType) -> pa.Table:
    cols = [np.concatenate(c) for c in zip(*rows, strict=True)] if rows else [np.empty(0)] * 4
    return pa.table({n: pa.array(c, t) for n, c, t in zip(("query_id", "query_place", "vec_id", "score"), cols, (pa.int64(), pa.int64(), pa.int64(), kind), strict=True)})


def _best(found: DataFrame, k: int) -> DataFrame:
    own = Window.partitionBy("query_id", "query_place").orderBy(F.col("score").desc(), F.col("vec_id"))
    return found.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


# --- exact ---


def branch_and_bound(q: np.ndarray, x: list[np.ndarray], rest_x: np.ndarray, rest_q: np.ndarray, first: np.ndarray, alive: np.ndarray, cuts: list[slice], k: int) -> tuple[np.ndarray, np.ndarray]:
    """The places and inner products of those of the candidates `alive` that can be among the k best of one query.

    x: candidates in vertical layout, an array (dimensions of the block, rows) per block. rest_x[j], rest_q[j]: norms of
    what is left after block j. first: products over block 0. What is left can add at most the product of both norms.
    """
    part = first[alive]
    bar = -np.inf
    for j in range(len(cuts)):
        if j:
            part = part + q[cuts[j]] @ x[j][:, alive]
        if j == len(cuts) - 1:
            break
        if len(alive) <= 4 * k:
            continue
        slack = rest_q[j] * rest_x[j][alive]
        if not np.isfinite(bar) or j % 2:  # the k most promising, in full: the k-th best cannot be worse
            seed = alive[np.argpartition(part, len(part) - k)[len(part) - k :]]
            whole = sum(q[c] @ b[:, seed] for c, b in zip(cuts, x, strict=True))
            bar = max(bar, whole.min())
        keep = part + slack * (1 + 1e-9) + 1e-6 >= bar
        alive, part = alive[keep], part[keep]
    return alive, part


def _exact_cell(k: int, dims: int):
    def run(key, candidates: pa.Table, queries: pa.Table) -> pa.Table:
        have, want, rows = _matrix(candidates), _matrix(queries), []
        for d, (q_ids, q, places) in want.items():
            if d not in have:
                continue
            ids, x, own = have[d]
            order = np.argsort(-(x * x).sum(0), kind="stable")  # blocks of large mass first
            cuts = [slice(a, min(a + dims, d)) for a in range(0, d, dims)]
            q = np.ascontiguousarray(q[:, order])
            blocks = [np.ascontiguousarray(x[:, order[c]].T) for c in cuts]
            after = lambda squares: np.sqrt(np.maximum(np.cumsum(squares[::-1], axis=0)[::-1], 0))
            rest_x = after(np.array([(b * b).sum(0) for b in blocks] + [np.zeros(len(ids))]))[1:]
            rest_q = after(np.array([(q[:, c] ** 2).sum(1) for c in cuts] + [np.zeros(len(q))]))[1:]
            for at in range(0, len(q), 128):
                first = q[at : at + 128, cuts[0]] @ blocks[0]
                for i in range(at, min(at + 128, len(q))):
                    alive, score = branch_and_bound(q[i], blocks, rest_x, rest_q[:, i], first[i - at], np.flatnonzero(own != places[i]), cuts, k)
                    best = _top(score, ids[alive], k)
                    n = len(best)
                    rows.append((np.full(n, q_ids[i]), np.full(n, places[i]), ids[alive[best]], score[best].astype(np.int64)))
        return _answer(rows, pa.int64())

    return run


def exact_top_k(vectors: DataFrame, is_query: Column, k: int, cells: Cells = Cells()) -> DataFrame:
    """vectors (id, v array<double> of whole numbers, place) -> query_id, rank, vec_id, score: the largest inner products.

    is_query: over id. Products are exact while sums of absolute products stay below 2**53. Vectors are compared only
    with those of equal length. A query's candidates are all rows but its own; rows that repeat an id are candidates
    each, and are answered each as queries. Fewer candidates than k are all returned; no queries or rows: no result.
    """
    queries = vectors.where(is_query)
    n, m = vectors.count(), queries.count()
    across, down = max(1, -(-n // cells.rows)), max(1, -(-m // cells.queries))
    left = vectors.withColumn("chunk", _deal(F.col("place"), F.lit(across))).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(down - 1))))
    right = queries.withColumn("block", _deal(F.col("place"), F.lit(down))).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(across - 1))))
    found = left.groupBy("chunk", "block").cogroup(right.groupBy("chunk", "block")).applyInArrow(_exact_cell(k, cells.dims), "query_id long, query_place long, vec_id long, score long")
    return _best(found, k)


def op7_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = usable(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    whole = v.withColumn("v", F.transform("v", lambda x: F.floor(64 * x).cast("double")))
    return exact_top_k(whole, F.col("id") % 20 == 0, 20)


def op7_sql() -> str:
    return """
      WITH v AS (SELECT vec_id, row_number() OVER () AS place, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
                 WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
                   AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
      s AS (SELECT q.vec_id AS query_id, q.place AS query_place, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
            FROM v q JOIN v c ON c.place <> q.place AND len(c.v) = len(q.v) WHERE q.vec_id % 20 = 0),
      r AS (SELECT *, row_number() OVER (PARTITION BY query_id, query_place ORDER BY score DESC, vec_id) AS rank FROM s)
      SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20"""


# --- approximate ---


class Index:
    """Centroids and a rotation fitted on a bounded sample of unit vectors of one length, and how many lists to probe."""

    def __init__(self, sample: np.ndarray, k: int, spec: Lists):
        rng = np.random.default_rng(spec.seed)
        d = sample.shape[1]
        self.rotation = np.linalg.qr(rng.standard_normal((d, d)))[0]
        lists = max(1, min(spec.lists, len(sample) // 8))
        self.centroids = sample[rng.choice(len(sample), lists, replace=False)]
        for _ in range(spec.rounds):
            near = self.nearest(sample, 1)[:, 0]
            sums = np.zeros_like(self.centroids)
            np.add.at(sums, near, sample)
            norm = np.linalg.norm(sums, axis=1, keepdims=True)
            self.centroids = np.where(norm > 0, sums / np.where(norm > 0, norm, 1), self.centroids)
        self.probes = self._probes(sample, k, spec.recall)

    def nearest(self, x: np.ndarray, n: int) -> np.ndarray:
        return np.argsort(-(x @ self.centroids.T), axis=1, kind="stable")[:, :n]

    def _probes(self, sample: np.ndarray, k: int, recall: float) -> int:
        """The fewest lists that hold this share of the k nearest, by brute force within the sample."""
        step = max(1, len(sample) // 512)
        own, q = self.nearest(sample, 1)[:, 0], np.arange(0, len(sample), step)
        close = sample[q] @ sample.T
        close[np.arange(len(q)), q] = -np.inf
        top = np.argsort(-close, axis=1, kind="stable")[:, : min(k, len(sample) - 1)]
        order = self.nearest(sample[q], len(self.centroids))
        turn = np.empty_like(order)
        np.put_along_axis(turn, order, np.arange(order.shape[1])[None, :], 1)
        needed = np.sort(np.take_along_axis(turn, own[top], 1).ravel())
        return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)]) + 1 if len(needed) else 1


def _unit(x: np.ndarray) -> np.ndarray:
    scale = np.abs(x).max(1, keepdims=True)
    x = x / np.where(scale > 0, scale, 1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _scaled(x: np.ndarray) -> np.ndarray:
    """x, each row divided by a power of two so that its squares neither overflow nor vanish; cosines stay the same to the bit."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])


def _assign(indexes: dict[int, Index], probe: bool):
    def run(batches):
        for batch in batches:
            part = pa.Table.from_batches([batch])
            for d, (ids, x, place) in _matrix(part).items():
                index = indexes.get(d)
                if index is None:  # no vector of this length in the sample: one list of its own
                    lists, n = np.zeros((len(ids), 1), int), 1
                else:
                    n = index.probes if probe else 1
                    lists = index.nearest(_unit(x), n)
                rows = np.repeat(np.arange(len(ids)), n)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * d, pa.int32()), pa.array(x[rows].ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(ids[rows]), flat, pa.array(place[rows]), pa.array([f"{d}:{i}" for i in lists.ravel()])], names=["id", "v", "place", "list"])

    return run


def adaptive_scan(q: np.ndarray, x: list[np.ndarray], cuts: list[slice], first: np.ndarray, alive: np.ndarray, k: int, doubt: float) -> np.ndarray:
    """The candidates left of `alive` after the last block of rotated dimensions.

    After t of d rotated dimensions, d/t times the partial squared distance estimates the whole one, with a relative
    deviation of about 1/sqrt(t). A candidate whose estimate lies beyond the k-th best whole distance so far by more
    than doubt deviations is given up.
    """
    d = cuts[-1].stop
    part, bar = first[alive], np.inf
    for j, c in enumerate(cuts):
        if j:
            part = part + ((x[j][:, alive] - q[c, None]) ** 2).sum(0)
        if j == len(cuts) - 1 or len(alive) <= 4 * k:
            continue
        if j % 2 == 0:
            seed = alive[np.argpartition(part, k)[:k]]
            whole = sum(((b[:, seed] - q[s, None]) ** 2).sum(0) for s, b in zip(cuts, x, strict=True))
            bar = min(bar, whole.max())
        reach = (1 + doubt / np.sqrt(c.stop)) ** 2
        keep = part * (d / c.stop) <= bar * reach
        alive, part = alive[keep], part[keep]
    return alive


def _scan_cell(indexes: dict[int, Index], k: int, dims: int, doubt: float):
    def run(key, candidates: pa.Table, queries: pa.Table) -> pa.Table:
        have, want, rows = _matrix(candidates), _matrix(queries), []
        for d, (q_ids, q, places) in want.items():
            if d not in have:
                continue
            ids, x, own = have[d]
            rotation = indexes[d].rotation if d in indexes else np.eye(d)
            cuts = [slice(a, min(a + dims, d)) for a in range(0, d, dims)]
            turned, rq = _unit(x) @ rotation, _unit(q) @ rotation
            blocks = [np.ascontiguousarray(turned[:, c].T) for c in cuts]
            x, q = _scaled(x), _scaled(q)
            x_norm, q_norm = np.sqrt((x * x).sum(1)), np.sqrt((q * q).sum(1))
            for at in range(0, len(q), 256):
                head = rq[at : at + 256, cuts[0]]
                first = (head**2).sum(1)[:, None] + (blocks[0] ** 2).sum(0)[None, :] - 2 * head @ blocks[0]
                for i in range(at, min(at + 256, len(q))):
                    alive = adaptive_scan(rq[i], blocks, cuts, first[i - at], np.flatnonzero(own != places[i]), k, doubt)
                    score = (x[alive] * q[i]).sum(1) / (x_norm[alive] * q_norm[i])
                    best = _top(score, ids[alive], k)
                    n = len(best)
                    rows.append((np.full(n, q_ids[i]), np.full(n, places[i]), ids[alive[best]], score[best]))
        return _answer(rows, pa.float64())

    return run


def _sizes(lists: DataFrame, most: int) -> DataFrame:
    """(list, parts): into how many parts of at most about `most` rows a list is dealt. A row per list."""
    return lists.groupBy("list").agg(F.ceil(F.count("*") / most).cast("int").alias("parts"))


def approximate_top_k(vectors: DataFrame, is_query: Column, k: int, spec: Lists = Lists(), cells: Cells = Cells(rows=8192, queries=2048)) -> DataFrame:
    """vectors (id, v array<double>, place) -> query_id, rank, vec_id, score: the largest cosines found.

    Every row is indexed; only centroids and the number of probes are fitted, on at most spec.sample rows that come
    first by the hash of their id. Zero vectors take no part. Vectors are compared only with those of equal length. A
    query's candidates are all rows but its own; rows that repeat an id are candidates each, and are answered each
    as queries. Scores are cosines of the original vectors in double precision.
    """
    vectors = vectors.where(F.exists("v", lambda x: x != 0))
    fit: dict[int, list] = {}
    for r in vectors.select("id", "place", "v").orderBy(F.xxhash64("id"), "place").limit(spec.sample).collect():
        fit.setdefault(len(r["v"]), []).append(r["v"])
    indexes = {d: Index(_unit(np.array(rows)), k, spec) for d, rows in fit.items() if len(rows) > 1}
    shape = "id long, v array<double>, place long, list string"
    filed, probing = vectors.mapInArrow(_assign(indexes, False), shape), vectors.where(is_query).mapInArrow(_assign(indexes, True), shape)
    # One row per list on either side: at most spec.lists for each vector length.
    across = _sizes(filed, cells.rows).withColumnRenamed("parts", "across")
    down = _sizes(probing, cells.queries).withColumnRenamed("parts", "down")
    grid = F.broadcast(across.join(down, "list"))
    left = filed.join(grid, "list").withColumn("chunk", _deal(F.col("place"), F.col("across"))).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("down") - 1)))
    right = probing.join(grid, "list").withColumn("block", _deal(F.col("place"), F.col("down"))).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("across") - 1)))
    left, right = (s.select("list", "chunk", "block", "id", "v", "place").groupBy("list", "chunk", "block") for s in (left, right))
    found = left.cogroup(right).applyInArrow(_scan_cell(indexes, k, cells.dims, spec.doubt), "query_id long, query_place long, vec_id long, score double")
    return _best(found, k)


def op8_adaptive_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return approximate_top_k(usable(table(spark, sf_dir, "embeddings"), "vec_id", "embedding"), F.col("id") % 50 == 0, 5)
