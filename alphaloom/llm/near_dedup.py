"""MinHash near-duplicate detection with min-max hashing.

Each random permutation of the shingle universe yields two values, the smallest and the largest hash of a set, so
half the hash evaluations give a signature of the same length; both estimate the Jaccard similarity without bias, and
as the two are negatively correlated their mean varies less than that of two independent ones. The signature is cut
into bands; sets that agree in a band share a bucket, and links are confirmed on full sets.

Sets that are equal form one class first, so copies cost nothing later. In a bucket every class is compared with a
pivot, not with every other: pairs grow with the rows. The pivot is the class that meets most others over all of its
buckets, which is the centre of a group of near copies. Where a bucket still spans several components after that, the
pairs across these components are looked at as well, apart from those that cannot be links: a set's parity sketch holds,
for each of a fixed number of cells, whether an odd number of its shingles falls into it, so the bits in which two
sketches differ are a lower bound on the shingles in which the sets differ. Buckets in which even that is too much are
dealt out anew by the prefix filter of exact set joins. A pair of similar sets in one bucket is thus never lost, and
pairs within a component are not emitted.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix64, release, stored, table, text_batches, trim, unused, utf8
from .graph import connected_components

#: Above this many ids the side is joined by a shuffle, not broadcast (8 bytes each).
BROADCAST_IDS = 1_000_000
#: Comparisons within a bucket above which its nodes are dealt out anew by the prefix filter.
HEAVY = 4_000_000
#: 64-bit words of a parity sketch.
SKETCH = 16
#: Shingles hashed at once: bounds the permuted block to PERMUTATIONS * BLOCK * 8 bytes.
BLOCK = 8192


@dataclass(frozen=True)
class MinMax:
    """shingle: words in a shingle. permutations give 2 values each; rows of them make a band.

    With 64 permutations and rows = 4 there are 32 bands: two sets at the threshold of 0.8 share none with
    probability (1 - 0.8**4)**32 = 5e-8, at 0.9 with 4e-15.
    """

    shingle: int = 5
    percent: int = 80
    permutations: int = 64
    rows: int = 4
    seed: int = 20240601


#: The columns of a parity sketch.
PARITY = [f"p{i}" for i in range(SKETCH)]


def words(text: bytes) -> list[bytes]:
    """Lower-cases A-Z and splits at space, tab, line feed, vertical tab, form feed, carriage return."""
    return text.lower().split()


def shingle_set(text: bytes | None, k: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the k-word shingles; of the whole sequence, if it has fewer words."""
    found = words(text) if text else []
    if not found:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    k = min(k, len(w))
    h = np.full(len(w) - k + 1, k, np.uint64)
    for i in range(k):
        h = h * np.uint64(0x9E3779B97F4A7C15) + w[i : len(w) - k + 1 + i]
        h = mix64(h)
    return np.unique(h)


class Signer:
    def __init__(self, spec: MinMax):
        rng = np.random.default_rng(spec.seed)
        self.a = rng.integers(0, 2**63, spec.permutations, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 2**63, spec.permutations, dtype=np.uint64)
        self.rows = spec.rows
        n_bands = 2 * spec.permutations // spec.rows
        self.salt = mix64(np.arange(1, n_bands + 1, dtype=np.uint64))

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        """All minima, then all maxima."""
        low, high = None, None
        for i in range(0, len(shingles), BLOCK):
            h = self.a[:, None] * shingles[None, i : i + BLOCK] + self.b[:, None]
            one, two = h.min(1), h.max(1)
            low = one if low is None else np.minimum(low, one)
            high = two if high is None else np.maximum(high, two)
        return np.concatenate([low, high])

    def bands(self, shingles: np.ndarray) -> np.ndarray:
        if not len(shingles):
            return np.empty(0, np.int64)
        sig = self.signature(shingles)
        m = sig[: len(self.salt) * self.rows].reshape(len(self.salt), self.rows)
        h = self.salt.copy()
        for j in range(self.rows):
            h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + m[:, j])
        return h.view(np.int64)


def parity(shingles: np.ndarray) -> np.ndarray:
    """The parity sketch of a set: bit i is set if an odd number of its shingles falls into cell i."""
    cells = np.bincount((mix64(shingles) % np.uint64(64 * SKETCH)).astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(cells.astype(np.uint8)).view(np.int64)


def _sign(spec: MinMax):
    def run(batches):
        release()
        signer = Signer(spec)
        for batch in batches:
            n, fps, bands, odd = [], [], [], []
            for text in utf8(batch.column("text")):
                s = shingle_set(text, spec.shingle)
                n.append(len(s))
                fps.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                bands.append(signer.bands(s))
                odd.append(parity(s))
            sketch = np.array(odd, np.int64).reshape(-1, SKETCH)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(fps, pa.binary()), pa.array(bands, pa.list_(pa.int64())), *(pa.array(sketch[:, i]) for i in range(SKETCH))],
                names=["doc_id", "n_shingles", "fp", "bands", *PARITY],
            )
        trim()

    return run


def _sets(spec: MinMax):
    def run(batches):
        release()
        for batch in batches:
            found = [shingle_set(t, spec.shingle) for t in utf8(batch.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in found], pa.binary()),
                    pa.array([s.view(np.int64) for s in found], pa.list_(pa.int64())),
                ],
                names=["fp", "shingles"],
            )
        trim()

    return run


def near_duplicates(docs: DataFrame, spec: MinMax = MinMax()) -> DataFrame:
    """docs (doc_id long, text string, ...) -> one row per row of docs: doc_id, n_shingles, component_id, kept.

    component_id is the smallest doc_id among all documents reachable over links of Jaccard similarity
    >= spec.percent / 100; kept marks it. Defined cases: null or empty text (or text of white space only) has
    n_shingles 0 and is linked with nothing; rows that repeat a doc_id with equal sets come back as often as given;
    a null doc_id comes back null, with the component of its text and kept false; an empty table gives no rows.
    Further columns of docs are ignored. Buckets of more than HEAVY comparisons are dealt out anew by the prefix filter, and
    lists of ids beyond BROADCAST_IDS are shuffled instead of broadcast: both change the way, not the links.
    """
    spark = docs.sparkSession
    text_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = stored(docs.mapInArrow(_sign(spec), "doc_id long, n_shingles long, fp binary, bands array<long>, " + ", ".join(f"{p} long" for p in PARITY)))
    one = F.first(F.struct(F.col("n_shingles").cast("int").alias("n"), "bands", *PARITY)).alias("one")
    classes = signed.where("fp is not null").groupBy("fp").agg(F.min("doc_id").alias("doc"), one).select("fp", "doc", "one.*")
    classes = stored(classes.withColumn("node", F.monotonically_increasing_id()))
    label = _components(docs, classes, spec)
    of_class = classes.select("fp", "node", "doc").join(label, "node", "left").select("fp", "doc", F.coalesce("component", "node").alias("component"))
    lowest = of_class.groupBy("component").agg(F.min("doc").alias("component_id"))
    named = of_class.join(lowest, "component").select("fp", "component_id")
    out = signed.select("doc_id", "n_shingles", "fp").join(named, "fp", "left")
    component = F.when(F.col("fp").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def deduplicate(docs: DataFrame, spec: MinMax = MinMax()) -> DataFrame:
    """docs with one row of each group of near duplicates: the one with the smallest doc_id, nulls last.

    Rows count, not ids: of rows that repeat each other one stays, rows with empty or null text all stay, and so do
    different texts under one id. Texts are only moved if more than BROADCAST_IDS rows go. An empty table gives no rows;
    further columns stay as they are, whatever they are called.
    """
    row = unused(docs, "row")
    key = [F.col("doc_id").isNull(), F.col("doc_id")] if "doc_id" in docs.columns else []
    numbered = stored(docs.withColumn(row, F.monotonically_increasing_id()))
    found = near_duplicates(numbered.select(F.col(row).alias("doc_id"), "text"), spec).select(F.col("doc_id").alias("row"), F.col("component_id").alias("group"))
    ids = numbered.select(F.col(row).alias("row"), F.struct(*key, F.col(row).alias("row")).alias("key"))
    grouped = stored(found.join(ids, "row"))
    stay = grouped.groupBy("group").agg(F.min("key").alias("key")).select(F.col("key.row").alias("row"))
    gone = stored(grouped.select("row").join(stay, "row", "left_anti").withColumnRenamed("row", row))
    if gone.count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    return numbered.join(gone, row, "left_anti").drop(row)


def _components(docs: DataFrame, classes: DataFrame, spec: MinMax) -> DataFrame:
    """(node, component) of all classes that have a link."""
    bucket = classes.select("node", F.explode("bands").alias("bucket"))
    shared = bucket.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    members = stored(bucket.join(shared, "bucket").select("bucket", "node", "size"))
    met = members.groupBy("node").agg(F.sum("size").alias("met"))
    centre = F.max(F.struct(F.col("met"), -F.col("node"))).alias("top")
    pivot = members.join(met, "node").groupBy("bucket").agg(centre).select("bucket", (-F.col("top.col2")).alias("pivot"))
    pairs = members.join(pivot, "bucket").where("node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b"))
    edges = stored(_links(docs, classes, pairs.distinct(), spec))
    label = stored(connected_components(edges))
    # What buckets that still span several components may hide.
    more = _links(docs, classes, _across(docs, classes, _spanning(members, label), spec), spec)
    return connected_components(edges.unionByName(more))


def _differ(x: str, y: str) -> Column:
    """In how many cells the parity sketches x.p* and y.p* differ; the sets differ in as many shingles at least."""
    return reduce(add, [F.bit_count(F.col(f"{x}.{p}").bitwiseXOR(F.col(f"{y}.{p}"))) for p in PARITY])


def _may_link(spec: MinMax, x: str, y: str) -> Column:
    """Whether sizes and parity sketches leave it open that two sets are linked.

    J >= t means that the sets differ in (1 - t) / (1 + t) of their summed sizes at most.
    """
    n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
    alike = F.lit(100).cast("long") * F.least(n, m) >= F.lit(spec.percent).cast("long") * F.greatest(n, m)
    return alike & ((100 + spec.percent) * _differ(x, y) <= (100 - spec.percent) * (n + m))


def _links(docs: DataFrame, classes: DataFrame, pairs: DataFrame, spec: MinMax) -> DataFrame:
    """Those of pairs (a, b) that are linked, confirmed on full sets where sketches leave it open."""
    known = classes.select("node", "n", *PARITY)
    x, y = known.withColumnRenamed("node", "a").alias("x"), known.withColumnRenamed("node", "b").alias("y")
    open_ = stored(pairs.join(x, "a").join(y, "b").where(_may_link(spec, "x", "y")).select("a", "b"))
    nodes = open_.select(F.col("a").alias("node")).unionByName(open_.select(F.col("b").alias("node"))).distinct()
    sets = _sets_of(docs, classes, nodes, spec)
    linked = 100 * F.col("both").cast("long") >= F.lit(spec.percent).cast("long") * (F.col("na") + F.col("nb") - F.col("both"))
    return _similarities(sets, open_).where(linked).select("a", "b")


def _spanning(members: DataFrame, label: DataFrame) -> DataFrame:
    """(bucket, node, component, main) of buckets whose nodes are in more than one component; main has most of them."""
    m = members.join(label, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("component"))
    several = m.groupBy("bucket", "component").agg(F.count("*").alias("k")).groupBy("bucket").agg(F.max(F.struct("k", "component")).alias("top"), F.count("*").alias("parts"))
    return m.join(several.where("parts > 1").select("bucket", F.col("top.component").alias("main")), "bucket")


def _across(docs: DataFrame, classes: DataFrame, rest: DataFrame, spec: MinMax) -> DataFrame:
    """The pairs (a, b) of a bucket, of different components, that can be similar enough.

    Each bucket has a component with most nodes; pairs need one node outside it, so a group of near copies is never
    paired with itself.
    """
    known = classes.select("node", "n", *PARITY)
    rest = stored(rest.join(known, "node"))
    sized = rest.groupBy("bucket").agg(F.count("*").alias("size"), F.count(F.when(F.col("component") != F.col("main"), 1)).alias("outside"))
    heavy = sized.where(F.col("size") * F.col("outside") > HEAVY).select("bucket")
    pairs = _met(rest.join(heavy, "bucket", "left_anti"), spec)
    dealt = stored(rest.join(heavy, "bucket", "left_semi").select("node", "component").distinct())
    if dealt.take(1):
        cut = stored(_prefix_buckets(dealt, _sets_of(docs, classes, dealt.select("node"), spec), spec))
        main = cut.groupBy("bucket", "component").agg(F.count("*").alias("k")).groupBy("bucket").agg(F.max(F.struct("k", "component")).alias("top"), F.count("*").alias("parts")).where("parts > 1")
        pairs = pairs.unionByName(_met(cut.join(main.select("bucket", F.col("top.component").alias("main")), "bucket").join(known, "node"), spec))
    return pairs.distinct()


def _met(m: DataFrame, spec: MinMax) -> DataFrame:
    """m (bucket, node, component, main, n, p*): the nodes outside main with all others of their bucket that they may link."""
    x, y = m.where("component <> main").alias("x"), m.alias("y")
    once = F.expr("x.bucket = y.bucket and x.component <> y.component and (y.component = y.main or x.node > y.node)")
    met = x.join(y, once & _may_link(spec, "x", "y"))
    return met.select(F.greatest("x.node", "y.node").alias("a"), F.least("x.node", "y.node").alias("b"))


def _prefix_buckets(nodes: DataFrame, sets: DataFrame, spec: MinMax) -> DataFrame:
    """nodes (node, component) -> with bucket: small buckets that keep each pair of similar sets together.

    In any order of the shingles, two sets of this similarity share one of the first n - ceil(n * similarity) + 1 of
    each. With the rarest first, texts that only have a common passage share none of these.
    """
    shingle = sets.select("node", F.explode("shingles").alias("s"))
    common = shingle.groupBy("s").agg(F.count("*").alias("f"))
    ordered = shingle.join(common, "s").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("f", "s"))).alias("all"))
    n = F.size("all")
    first = n - F.ceil(n * spec.percent / 100 - 1e-9) + 1
    kept = nodes.join(ordered, "node").select("node", "component", F.explode(F.slice("all", F.lit(1), first.cast("int"))).alias("t")).where("t.f > 1")
    return kept.select(F.col("t.s").alias("bucket"), "node", "component")


def _sets_of(docs: DataFrame, classes: DataFrame, nodes: DataFrame, spec: MinMax) -> DataFrame:
    """(node, shingles array<long>): the full sets of some classes, made again from a text of each."""
    wanted = stored(classes.select("node", "fp", "doc").join(nodes, "node", "left_semi"))
    ids = wanted.select(F.col("doc").alias("wanted_doc")).distinct()
    if wanted.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    texts = docs.join(ids, docs["doc_id"].eqNullSafe(F.col("wanted_doc")), "left_semi").select("text")
    sets = texts.mapInArrow(_sets(spec), "fp binary, shingles array<long>")
    return stored(wanted.select("node", "fp").join(sets, "fp").dropDuplicates(["node"]).select("node", "shingles"))


def _similarities(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (a, b) of classes -> a, b, na, nb, both: sizes of their full sets and of what these share."""
    one = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    two = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", F.size("sa").alias("na"), F.size("sb").alias("nb"), F.size(F.array_intersect("sa", "sb")).alias("both"))


def op2_minmax_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), MinMax(shingle=4))
