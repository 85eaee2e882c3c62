"""A quality classifier by compression.

Two zstandard dictionaries are built from texts labelled good and bad. A text is compressed with each of them and with
none; the difference of the first two sizes, normalised by their sum, says which kind of text it is like, and the sizes
themselves, normalised by the text's length, how much it repeats itself. A logistic calibration on labelled rows that the
dictionaries have not seen makes them a score. (The difference alone does worse on held-out rows; see README.)
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fitting, held, table, text_batches, trim, utf8


@dataclass(frozen=True)
class Fit:
    """per_class: labelled texts per class for the dictionary and as many times `calibrate` for the calibration, at most.

    The rows that come first by the hash of their id are taken, whole, until sample_bytes is reached.
    """

    per_class: int = 1000
    calibrate: int = 4
    sample_bytes: int = 64_000_000
    dictionary: int = 65_536
    level: int = 3
    threshold: float = 0.7


@dataclass(frozen=True)
class Model:
    """good, bad: dictionaries. mean, scale, weights: of the calibration over the features; the last weight is constant."""

    good: bytes
    bad: bytes
    level: int
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]


def _compressors(good: bytes, bad: bytes, level: int) -> list[zstandard.ZstdCompressor]:
    made = [zstandard.ZstdCompressionDict(d) if d else None for d in (good, bad, b"")]
    return [zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_dict_id=False) for d in made]


def features(model: Model, texts: list[bytes]) -> np.ndarray:
    good, bad, none = (np.array([len(c.compress(t)) for t in texts], float) for c in held(_compressors, model.good, model.bad, model.level))
    size = np.array([len(t) for t in texts], float) + 1
    return np.column_stack([(bad - good) / (bad + good), good / size, none / size, np.log(size), (none - good) / size, (none - bad) / size])


def _terms(model: Model, x: np.ndarray) -> np.ndarray:
    """The standardised features, and 1."""
    return np.column_stack([(x - np.array(model.mean)) / np.array(model.scale), np.ones(len(x))])


def scores(model: Model, texts: list[bytes]) -> np.ndarray:
    if not model.weights or not texts:
        return np.full(len(texts), 0.5)
    return 1 / (1 + np.exp(-np.clip(_terms(model, features(model, texts)) @ np.array(model.weights), -500, 500)))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Newton's method; a step that does not lower the loss is halved."""

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float(np.logaddexp(0, z).sum() - y @ z + ridge / 2 * w @ w)

    w = np.zeros(x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        while loss(w + step) > loss(w) and np.abs(step).max() > 1e-9:
            step /= 2
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _dictionary(texts: list[bytes], size: int) -> bytes:
    try:
        return zstandard.train_dictionary(size, texts).as_bytes()
    except zstandard.ZstdError:  # too few samples to train on: their end is the dictionary
        return b"".join(texts)[-size:]


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 2 when divided by 4. A null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, spec: Fit = Fit()) -> Model:
    """Learns from the labelled rows that are not held out. Without texts of both classes every score is 0.5.

    The sample's size is bounded by spec, so it is fitted on the driver. An id labelled both ways counts as bad.
    """
    per_class = spec.per_class * (1 + spec.calibrate)
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    drawn = [known.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for q in (0, 1)]
    drawn = F.broadcast(drawn[0].unionByName(drawn[1]))
    texts = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    sized = texts.join(drawn, "doc_id").groupBy("doc_id", "quality").agg(F.max(F.octet_length("text")).alias("size")).collect()
    sized.sort(key=lambda r: (r["quality"], r["doc_id"]))
    order = {q: np.random.default_rng(q).permutation([r["doc_id"] for r in sized if r["quality"] == q]).tolist() for q in (0, 1)}
    size = {r["doc_id"]: r["size"] for r in sized}
    taken: list[int] = []
    for q in (0, 1):
        taken += [order[q][i] for i in fitting([size[i] for i in order[q]], spec.sample_bytes // 2)]
    if not taken:
        return Model(b"", b"", spec.level, (), (), ())
    chosen = F.broadcast(docs.sparkSession.createDataFrame(pa.table({"doc_id": pa.array(taken, pa.int64())})))
    text = {r["doc_id"]: r["text"].encode() for r in texts.join(chosen, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text")).collect()}
    by = {q: [text[i] for i in order[q] if i in text] for q in (0, 1)}
    if not by[0] or not by[1]:
        return Model(b"", b"", spec.level, (), (), ())
    cut = {q: min(spec.per_class, -(-len(by[q]) // 2)) for q in (0, 1)}
    good, bad = (_dictionary(by[q][: cut[q]], spec.dictionary) for q in (1, 0))
    raw = Model(good, bad, spec.level, (), (), ())
    rest = {q: by[q][cut[q] :] or by[q] for q in (0, 1)}
    x = features(raw, rest[1] + rest[0])
    y = np.r_[np.ones(len(rest[1])), np.zeros(len(rest[0]))]
    ready = replace(raw, mean=tuple(x.mean(0).tolist()), scale=tuple(np.where(x.std(0) > 0, x.std(0), 1).tolist()))
    return replace(ready, weights=tuple(_logistic(_terms(ready, x), y).tolist()))


def score_column(model: Model, text: Column) -> Column:
    """The score of a text column, 0 to 1, whole texts; null counts as empty."""

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        trim()
        return pa.array(scores(model, [t or b"" for t in utf8(texts)]), pa.float64())

    return score(text.cast("string"))


def classify(docs: DataFrame, labels: DataFrame, spec: Fit = Fit()) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, held_out, score, predicted per row.

    Defined cases: null and empty text get the calibrated score of an empty text; repeated rows and null ids come back
    as given; an empty table gives no rows; labels, lang, source and doc_id are no inputs of a score.
    """
    text_batches(docs.sparkSession)
    model = fit(docs, labels, spec)
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), score_column(model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= spec.threshold).cast("int"))


def op5_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
