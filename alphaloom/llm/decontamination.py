"""Benchmark decontamination: word windows of test items, looked up in every document.

The distinct windows of all items are a hash set. Where their number is within a bound it is broadcast and every document
window probes it as it is generated, without a shuffle; beyond that bound the hashes of document windows are shuffled. A
window counts only if its words are equal, not just its hash. All of it is DataFrame expressions inside the JVM.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import merged, row_key, stored, table, unused

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What stands between words: all of ASCII but digits and letters.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"


@dataclass(frozen=True)
class Windows:
    """words: in a window. broadcast: windows that are sent to all executors at most; of more the hashes are shuffled."""

    words: int = 10
    broadcast: int = 500_000


def words_of(text: Column) -> Column:
    """The words of a text, A-Z lower-cased: runs of digits, a-z and all that is not ASCII. Null has none."""
    return F.array_remove(F.split(F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER), BETWEEN + "+"), "")


def _window(words: Column, at: Column, length: Column) -> Column:
    return F.slice(words, at + 1, length)


def windows_of(items: DataFrame, item_id: str, text: str, spec: Windows) -> DataFrame:
    """(item_id, length, window): every window of every item once; an item of fewer words is one window."""
    n = F.size("words")
    cut = items.select(items[item_id].alias("item_id"), words_of(items[text]).alias("words")).where(n > 0)
    at = cut.select("item_id", "words", F.least(n, F.lit(spec.words)).alias("length"), F.explode(F.sequence(F.lit(0), F.greatest(n - spec.words, F.lit(0)))).alias("at"))
    return at.select("item_id", "length", _window(F.col("words"), F.col("at"), F.col("length")).alias("window")).distinct()


def scan(rows: DataFrame, windows: DataFrame, spec: Windows) -> DataFrame:
    """rows (key, ..., words), windows (length, window) -> (key, ..., n_words, at, length, id): of every row one line at
    place -1, and one for each place where a window occurs; id is the window's hash of 128 bits. Texts are cut once.

    Only windows of lengths that occur are generated.
    """
    distinct = windows.select("length", "window").distinct()
    lengths = sorted(r["length"] for r in distinct.groupBy("length").count().collect()) or [spec.words]  # at most spec.words rows
    few = distinct.limit(spec.broadcast + 1).count() <= spec.broadcast
    known = distinct.select(F.col("length").alias("__length"), F.col("window").alias("__window"), F.xxhash64("window").alias("__hash"), F.md5(F.array_join("window", " ")).alias("id"))
    own, n, at, length = [c for c in rows.columns if c != "words"], F.size("words"), F.col("at"), F.col("length")
    placed = rows.select(*own, n.alias("n_words"), "words", F.explode(F.sequence(F.lit(-1), F.greatest(n - lengths[0], F.lit(-1)))).alias("at"))
    if len(lengths) == 1:
        placed = placed.withColumn("length", F.lit(lengths[0]))
    else:
        placed = placed.select("*", F.explode(F.array(*map(F.lit, lengths))).alias("length"))
        placed = placed.where((at + length <= F.col("n_words")) & ((at >= 0) | (length == lengths[0])) | (at < 0) & (length == lengths[0]))
    window = _window(F.col("words"), at, length)
    hashed = F.when(at >= 0, F.xxhash64(window))
    # Inside coalesce it is no key of the join, so words are compared only where hashes are equal.
    same = F.coalesce((length == F.col("__length")) & (window == F.col("__window")), F.lit(False))
    out = [*own, "n_words", "at", "length", "id"]
    if few:
        return placed.join(F.broadcast(known), (hashed == F.col("__hash")) & same, "left").where(F.col("id").isNotNull() | (at < 0)).select(*out)
    likely = placed.select("key", "at", "length", hashed.alias("__hash")).join(known.select("__hash").distinct(), "__hash", "left_semi")
    found = likely.join(rows.dropDuplicates(["key"]).withColumn("n_words", n), "key").join(known, "__hash").where(same).select(*out)
    return rows.select(*own, n.alias("n_words"), F.lit(-1).alias("at"), F.lit(0).alias("length"), F.lit(None).cast("string").alias("id")).unionByName(found)


def contamination(docs: DataFrame, items: DataFrame, spec: Windows = Windows(), doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows, found). rows: doc_id, key, n_words of every document row. found, of each key with hits: n_hit words inside
    any occurrence of a window, spans (start, end) of such words, items whose windows occur.

    Null and empty texts have no words and no hits. Rows that repeat id and text share a key, each keeps its row in rows;
    equal texts under other ids are found for each id. An item of no words has no windows; a null item_id marks words but is
    not listed; items under one id count as one. Without items or documents nothing is found. Other columns play no part.
    """
    rows = docs.select(docs[doc_id].alias("doc_id"), row_key(docs[doc_id], docs[text]).alias("key"), words_of(docs[text]).alias("words"))
    windows = stored(windows_of(items, item_id, item_text, spec))
    lines = stored(scan(rows, windows, spec))
    at = lines.where("at >= 0")
    spans = merged(at.select("key", F.col("at").alias("start"), (F.col("at") + F.col("length")).alias("end")), "key")
    spans = spans.groupBy("key").agg(F.sum(F.col("end") - F.col("start")).alias("n_hit"), F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))
    of_items = windows.where("item_id is not null").select(F.md5(F.array_join("window", " ")).alias("id"), F.col("item_id").cast("string").alias("item"))
    if of_items.limit(spec.broadcast + 1).count() <= spec.broadcast:
        of_items = F.broadcast(of_items)
    listed = at.select("key", "id").distinct().join(of_items, "id").select("key", "item").distinct()
    listed = listed.groupBy("key").agg(F.array_sort(F.collect_list("item")).alias("items"))
    found = spans.join(listed, "key", "left").withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
    return lines.where("at < 0").select("doc_id", "key", "n_words"), found


def _left(docs: DataFrame, found: DataFrame, key: Column, most: int, name: str) -> DataFrame:
    """docs with what was found as one struct column, null for the rest; found is broadcast within a bound of its rows."""
    found = stored(found)
    small = found.select(F.sum(F.size("spans") + F.size("items"))).first()[0] or 0  # its arrays are what is large
    packed = found.select(F.col("key").alias(f"{name}_key"), F.struct("spans").alias(name))
    met = docs.join(F.broadcast(packed) if small <= most else packed, key == F.col(f"{name}_key"), "left")
    return met.drop(f"{name}_key")


def without_documents(docs: DataFrame, items: DataFrame, spec: Windows = Windows(), most_hit: float = 0.0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without those of whose words more than the share most_hit is hit; columns and repeated rows stay as they are."""
    _, found = contamination(docs, items, spec, doc_id, text)
    name = unused(docs, "__found")
    met = _left(docs, found, row_key(docs[doc_id], docs[text]), spec.broadcast, name)
    n_hit = F.aggregate(F.col(name)["spans"], F.lit(0), lambda total, s: total + s["end"] - s["start"])
    keep = F.col(name).isNull() | (n_hit <= most_hit * F.size(words_of(F.col(text))))
    return met.where(keep).drop(name)


def without_spans(docs: DataFrame, items: DataFrame, spec: Windows = Windows(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs whose texts lack the hit words, each with what stands between it and the word before it; all else stays."""
    _, found = contamination(docs, items, spec, doc_id, text)
    name = unused(docs, "__found")
    met = _left(docs, found, row_key(docs[doc_id], docs[text]), spec.broadcast, name)
    word = "[^" + BETWEEN[1:] + "+"
    piece = F.regexp_extract_all(F.col(text), F.lit(f"{BETWEEN}*{word}"), F.lit(0))
    tail = F.regexp_extract(F.col(text), f"({BETWEEN}*)\\z", 1)
    spans = F.col(name)["spans"]
    keep = F.zip_with(  # from the end of a span, or the beginning, to the start of the next, or the end
        F.concat(F.array(F.lit(0)), F.transform(spans, lambda s: s["end"])),
        F.concat(F.transform(spans, lambda s: s["start"]), F.array(F.lit(2**31 - 1))),
        lambda a, b: F.struct(a.alias("a"), b.alias("b")),
    )
    kept: Callable[[Column], Column] = lambda g: F.array_join(F.slice(F.col(f"{name}_pieces"), g["a"] + 1, g["b"] - g["a"]), "")
    cleaned = F.concat(F.array_join(F.transform(keep, kept), ""), tail)
    cut = met.withColumn(f"{name}_pieces", F.when(F.col(name).isNotNull(), piece))
    return cut.withColumn(text, F.when(F.col(name).isNull(), F.col(text)).otherwise(cleaned)).select(*docs.columns)


def op12_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    met, none = rows.join(found, "key", "left"), F.lit(0).cast("long")
    n_hit = F.coalesce("n_hit", none)
    return met.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("n_words").cast("long").alias("n_words"), n_hit.alias("n_hit"),
        F.coalesce(F.size("items").cast("long"), none).alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def op12_sql() -> str:
    words = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return rf"""
      WITH d AS (SELECT doc_id, row_number() OVER () AS r, {words} AS w FROM documents),
      b AS (SELECT item_id, {words} AS w FROM benchmark),
      win AS (SELECT DISTINCT item_id::VARCHAR AS item, list_slice(w, (i + 1)::BIGINT, (i + 10)::BIGINT) AS g
              FROM (SELECT item_id, w, unnest(range(0, greatest(len(w) - 9, 1))) AS i FROM b WHERE len(w) > 0)),
      size AS (SELECT DISTINCT len(g) AS l FROM win),
      placed AS (SELECT r, l, i, list_slice(w, (i + 1)::BIGINT, (i + l)::BIGINT) AS g
                 FROM (SELECT r, w, l, unnest(range(0, len(w) - l + 1)) AS i FROM d JOIN size ON len(w) >= l)),
      hit AS (SELECT r, i, l, item FROM placed JOIN win USING (g)),
      inside AS (SELECT r, count(DISTINCT place) AS n_hit FROM (SELECT r, unnest(range(i, i + l)) AS place FROM (SELECT DISTINCT r, i, l FROM hit)) GROUP BY r),
      item AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
      SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
             sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
      FROM d LEFT JOIN inside USING (r) LEFT JOIN item USING (r)"""
