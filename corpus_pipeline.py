"""A training corpus from raw documents: language, quality, near duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents, in
their order and whatever further ones are called. Rows count, not ids: rows that repeat each other, and null ids, go
through each stage as rows of their own. Empty tables give empty tables. Texts of any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alphaloom.llm import language_id, near_dedup, packing, pii, quality
from alphaloom.llm.common import stored, table, text_batches

#: Below this score a document is rejected. Looser than the classifier's own 0.7, so that doubtful documents stay.
LEAST_QUALITY = 0.5


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that are in no language: null, empty and blank texts, and noise.

    The source stands for a host; a null one is a host of its own. Ties between languages reject nothing. If no document
    has a language to learn from, all are rejected.
    """
    found = language_id.fused(docs, language_id.fit(docs), F.col("text"), F.col("source"))
    return found.where("__found.in_language").drop("__found")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that compress like texts labelled bad. Without labels of both kinds all stay.

    A score equal to the bound stays; null and empty texts have the score of an empty text.
    """
    text_batches(spark)
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return docs.where(quality.score_column(model, F.col("text")) >= LEAST_QUALITY)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose shingles of five words agree to 0.8 or more: the one of the smallest id.

    Of rows that repeat each other one stays; empty and null texts are linked with nothing and all stay.
    """
    return near_dedup.deduplicate(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in texts by their kind, as in <email>; no document goes, null texts stay null.

    Of spans that overlap the first counts, of two that begin together the longer one. n_chars becomes the new length.
    """
    return pii.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document packed into sequences of at most 2048: a row per piece, as op10 gives them.

    Null and empty texts are one end token; equal lengths are interchangeable, so ties have no meaning.
    """
    import public_tokenizers

    # The workers have all stages' libraries loaded by now, so they take fewer texts at once than op10's.
    return packing.pack(docs, packing.Packing(public_tokenizers.path("word_bpe_49k.json"), batch=256, remembered=40_000))


STAGES = [
    ("language ID", keep_languages),
    ("quality classifier", keep_quality),
    ("MinHash near-dedup", drop_near_duplicates),
    ("PII", redact_personal_data),
    ("best-fit packing", pack_sequences),
]

#: No stage but the first filter could be told in SQL: classifiers, signatures and tokenizers are not.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
