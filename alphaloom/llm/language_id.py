"""Language identification by fusing evidence.

Four kinds of evidence are multiplied, as if independent given the language: the text's likelihood under a byte trigram
model of each language, the language that the markup declares, the language that the address suggests, and the prior of
its host. What declarations and suffixes are worth, and what hosts tend to, is learned from the corpus itself by grouped
aggregation of the text's own posteriors; a host's prior is smoothed towards its domain's and that towards the
corpus's, and leaves out the document in question.

A text that no language explains better than a model of shuffled bytes is in none and is rejected.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fitting, release, stored, table, text_batches
from .url_filter import url_parts

#: Host tables up to this many rows are broadcast; larger ones are joined by a shuffle.
BROADCAST_HOSTS = 200_000
BUCKETS = 1 << 16
#: Languages that a corpus can have; of more labels those with most documents count.
MOST_LANGUAGES = 200
#: Bytes of a text looked at in one step; whole texts are read.
STEP = 1 << 16


@dataclass(frozen=True)
class Fit:
    """per_language: texts that train a language's model, at most, first by the hash of their id, up to sample_bytes
    in all; texts that do not fit are passed over. A language with none that fits has its shortest text.

    full: how many trigrams of evidence a text can give at most. smoothing: weight of a host's domain, and of the corpus
    in a domain's. least: mean log-likelihood ratio to shuffled bytes below which a text is in no language.
    """

    per_language: int = 400
    sample_bytes: int = 4_000_000
    full: float = 200.0
    smoothing: float = 5.0
    least: float = 0.25
    sure: float = 0.5


@dataclass(frozen=True)
class Model:
    """ratio: (BUCKETS, languages) log-likelihood ratios of trigrams to shuffled bytes."""

    languages: tuple[str, ...]
    ratio: np.ndarray


def _buckets(data: bytes) -> np.ndarray:
    a = np.frombuffer(data, np.uint8).astype(np.uint64)
    if len(a) < 3:
        return np.empty(0, np.int64)
    code = (a[:-2] << np.uint64(16)) | (a[1:-1] << np.uint64(8)) | a[2:]
    return ((code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.int64)


def _plain(text: str) -> bytes:
    return (" " + text.lower() + " ").encode()


def fit(docs: DataFrame, spec: Fit = Fit()) -> Model:
    """docs (doc_id, text, lang) -> the trigram models; a bounded sample of labelled rows is fitted on the driver."""
    known = docs.where("doc_id is not null and text is not null and lang is not null and text <> ''").select("doc_id", "lang", F.col("text").cast("string").alias("text"))
    languages = sorted(r["lang"] for r in known.groupBy("lang").count().orderBy(F.col("count").desc(), "lang").limit(MOST_LANGUAGES).collect())
    texts: dict[str, list[str]] = {}
    for lang in languages:
        # Ids and sizes first, so that no texts but those taken are moved.
        own = known.where(F.col("lang") == lang)
        sized = own.select("doc_id", F.octet_length("text").alias("size"))
        few = sized.where(F.col("size") <= spec.sample_bytes).orderBy(F.xxhash64("doc_id"), "doc_id", "size").limit(spec.per_language).collect()
        few = few or sized.orderBy("size", "doc_id").limit(1).collect()
        taken = [few[i]["doc_id"] for i in fitting([r["size"] for r in few], spec.sample_bytes) or [0]]
        rows = own.where(F.col("doc_id").isin(sorted(set(taken)))).groupBy("doc_id").agg(F.min("text").alias("text")).collect()
        if rows:
            texts[lang] = [r["text"] for r in sorted(rows, key=lambda r: r["doc_id"])]
    languages = [x for x in languages if x in texts]
    joined = [b"".join(map(_plain, texts[x])) for x in languages]
    ratio = np.zeros((BUCKETS, max(1, len(languages))), np.float32)
    if joined:
        every = np.frombuffer(b"".join(joined), np.uint8)
        shuffled = np.random.default_rng(1).permutation(every).tobytes()
        logs = [np.log((np.bincount(_buckets(d), minlength=BUCKETS) + 0.5) / (len(d) + 0.5 * BUCKETS)) for d in (*joined, shuffled)]
        ratio = np.column_stack([x - logs[-1] for x in logs[:-1]]).astype(np.float32)
    return Model(tuple(languages), ratio)


def mean_ratios(model: Model, text: str | None) -> tuple[np.ndarray, int]:
    """The mean log-likelihood ratio of each language over the whole text, and the number of its trigrams."""
    data = _plain(text) if text and not text.isspace() else b""
    total, n = np.zeros(model.ratio.shape[1]), 0
    for at in range(0, max(0, len(data) - 2), STEP):
        b = _buckets(data[at : at + STEP + 2])
        total += model.ratio[b].sum(0, dtype=np.float64)
        n += len(b)
    return total / max(n, 1), n


def text_evidence(model: Model, spec: Fit, text: Column) -> Column:
    """struct: logs, each language's tempered log-likelihood ratio; own, their posteriors, zeros where no language
    explains the text; speaks, whether one does."""

    kind = pa.struct([("logs", pa.list_(pa.float64())), ("own", pa.list_(pa.float64())), ("speaks", pa.bool_())])

    @F.arrow_udf("struct<logs: array<double>, own: array<double>, speaks: boolean>")
    def evidence(texts: pa.Array) -> pa.Array:
        release()
        logs, own, speaks = [], [], []
        for t in texts.to_pylist():
            mean, n = mean_ratios(model, t)
            log = mean * (n / (1 + n / spec.full))
            does = bool(n and mean.max() >= spec.least)
            p = np.exp(log - log.max())
            logs.append(log)
            own.append(p / p.sum() if does else np.zeros(len(p)))
            speaks.append(does)
        return pa.StructArray.from_arrays([pa.array(x, f.type) for x, f in zip((logs, own, speaks), kind, strict=True)], fields=list(kind))

    return evidence(text.cast("string"))


def _smoothed(counts: Column, own: Column, base: Column, weight: float) -> Column:
    """Counts without the document's own, smoothed towards base."""
    left = F.zip_with(counts, own, lambda c, o: F.greatest(c - o, F.lit(0.0)))
    total = F.aggregate(left, F.lit(0.0), lambda t, x: t + x)
    return F.zip_with(left, base, lambda c, b: (c + weight * b) / (total + weight))


def _softmax(logs: Column) -> Column:
    each = F.transform(logs, lambda x: F.exp(x - F.array_max(logs)))
    total = F.aggregate(each, F.lit(0.0), lambda t, x: t + x)
    return F.transform(each, lambda x: x / total)


def _known(code: Column, languages: tuple[str, ...]) -> Column:
    """A declared code as one of the languages, `other` or `none`: few values, whatever pages declare."""
    low = F.lower(F.substring(F.trim(code.cast("string")), 1, 2))
    return F.when(low.isin(*languages), low).when(F.coalesce(F.length(low), F.lit(0)) > 0, F.lit("other")).otherwise(F.lit("none"))


def domain_of(host: Column) -> Column:
    """The last two labels of a host name."""
    return F.substring_index(host, ".", -2)


def identify(df: DataFrame, model: Model, text: Column, host: Column, declared: Column | None = None, suffix: Column | None = None, spec: Fit = Fit()) -> DataFrame:
    """Adds lang_found string, posterior double and in_language boolean to df; its other columns stay as they are.

    Columns of df with one of these three names, in any case, give way to the results; where they are to be kept, take
    `fused`. Defined cases: null, empty or blank text, and text that no language explains, has lang `und`, posterior 0 and
    in_language false; a null host is a host of its own; missing declarations and suffixes are evidence of their own
    kind; ties go to the first language by name; an empty table gives no rows. One aggregation by host, one by
    declaration and suffix; hosts are summed before the shuffle, so one host may hold any share of the rows.
    """
    kept = [F.col(f"`{c}`") for c in df.columns if c.lower() not in RESULTS]
    return fused(df, model, text, host, declared, suffix, spec).select(*kept, *[F.col("__found")[c].alias(c) for c in RESULTS])


#: What identify adds.
RESULTS = ("lang_found", "posterior", "in_language")


def fused(df: DataFrame, model: Model, text: Column, host: Column, declared: Column | None = None, suffix: Column | None = None, spec: Fit = Fit()) -> DataFrame:
    """df as it is, whatever its columns are called, with the results of identify in one struct `__found`.

    Names that begin with two underscores are reserved.
    """
    spark, langs = df.sparkSession, model.languages
    own_columns = [F.col(f"`{c}`") for c in df.columns]
    if not langs:
        return df.select(*own_columns, F.struct(F.lit("und").alias("lang_found"), F.lit(0.0).alias("posterior"), F.lit(False).alias("in_language")).alias("__found"))
    text_batches(spark)
    k = range(len(langs))
    evidence = df.select(
        *own_columns,
        text_evidence(model, spec, text).alias("__e"),
        F.coalesce(host.cast("string"), F.lit("")).alias("__host"),
        (_known(declared, langs) if declared is not None else F.lit("none")).alias("__declared"),
        (_known(suffix, langs) if suffix is not None else F.lit("none")).alias("__suffix"),
    )
    sums = [F.sum(F.col("__e.own")[i]).alias(f"p{i}") for i in k]
    cells = stored(evidence.groupBy("__host", "__declared", "__suffix").agg(*sums))
    whole = cells.agg(*[F.coalesce(F.sum(f"p{i}"), F.lit(0.0)).alias(f"p{i}") for i in k]).first()
    corpus = F.array(*[F.lit((whole[f"p{i}"] + 1) / (sum(whole) + len(langs))) for i in k])
    by_host = cells.groupBy("__host").agg(*[F.sum(f"p{i}").alias(f"p{i}") for i in k]).withColumn("__domain", domain_of(F.col("__host")))
    by_domain = by_host.groupBy("__domain").agg(F.array(*[F.sum(f"p{i}") for i in k]).alias("__d"))
    priors = by_host.join(by_domain, "__domain").select("__host", "__d", F.array(*[f"p{i}" for i in k]).alias("__h"))
    if priors.count() <= BROADCAST_HOSTS:
        priors = F.broadcast(priors)
    primed = evidence.join(priors, "__host", "left")
    own = F.col("__e.own")
    primed = primed.withColumn("__prior", _smoothed(F.col("__h"), own, _smoothed(F.col("__d"), own, corpus, spec.smoothing), spec.smoothing))
    logs = F.zip_with("__e.logs", "__prior", lambda x, p: x + F.log(p))
    for column, given in (("__declared", declared), ("__suffix", suffix)):
        if given is not None:
            logs = F.zip_with(logs, F.element_at(_worth(cells, column, langs), F.col(column)), lambda x, w: x + w)
    named = primed.withColumn("__logs", logs).withColumn("__post", _softmax(F.col("__logs")))
    best, speaks = F.array_max("__post"), F.col("__e.speaks")
    lang = F.element_at(F.array(*[F.lit(x) for x in langs]), F.array_position("__post", best).cast("int"))
    found = F.struct(
        F.when(speaks, lang).otherwise(F.lit("und")).alias("lang_found"),
        F.when(speaks, best).otherwise(F.lit(0.0)).alias("posterior"),
        (speaks & (best >= spec.sure)).alias("in_language"),
    )
    return named.select(*own_columns, found.alias("__found"))


def _worth(cells: DataFrame, column: str, langs: tuple[str, ...]) -> Column:
    """A map value -> array of log P(value | language), smoothed. Values are the languages, other and none."""
    rows = {r[column]: r for r in cells.groupBy(column).agg(*[F.sum(f"p{i}").alias(f"p{i}") for i in range(len(langs))]).collect()}
    values = [*langs, "other", "none"]
    n = np.array([[(rows[v][f"p{i}"] if v in rows else 0.0) + 1.0 for i in range(len(langs))] for v in values])
    log = np.log(n / n.sum(0))
    return F.create_map(*[x for v, row in zip(values, log.tolist(), strict=True) for x in (F.lit(v), F.array(*map(F.lit, row)))])


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents: text and the prior of their source, which stands for a host."""
    docs = table(spark, sf_dir, "documents")
    found = identify(docs.select("doc_id", "text", "source"), fit(docs), F.col("text"), F.col("source"))
    return found.select("doc_id", F.col("lang_found").alias("lang"), "posterior", F.col("in_language").alias("kept"))


def pages_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw pages: visible text, the html element's lang, the path's or top level domain's language, and the host.

    Pages with null or empty html have language `und`; a null url, or one without a host, has the empty host, which is
    one of its own; repeated pages and null ids come back as given; an empty table gives no rows.
    """
    pages, docs = table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents")
    model = fit(docs)
    host, path, _ = url_parts(F.col("url"))
    visible = F.regexp_replace("html", r"(?is)<script.*?</script>|<style.*?</style>|<[^>]*>|&[a-z]+;", " ")
    first = F.regexp_extract(path, r"^/([a-z]{2})(?:/|$)", 1)
    suffix = F.when(first != "", first).otherwise(F.substring_index(host, ".", -1))
    ready = pages.select("page_id", visible.alias("text"), host.alias("host"), F.regexp_extract("html", r"(?i)<html[^>]*\slang=[\"']?([a-z]{2})", 1).alias("declared"), suffix.alias("suffix"))
    found = identify(ready, model, F.col("text"), F.col("host"), F.col("declared"), F.col("suffix"))
    return found.select("page_id", "host", F.col("lang_found").alias("lang"), "posterior", F.col("in_language").alias("kept"))
