"""Five stages from raw documents to tokens. Each takes (spark, docs, sf_dir) and works on all that the stage before kept.

All but the last return the columns of documents: doc_id, text, lang, source, n_chars.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm import bpe, langid, mixing, simhash, substring
from pulsegrid.llm._common import discard, materialise, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents in no language (no letter, or no text); lang becomes the language found."""
    got = langid.identify(docs, *langid.train_fold(docs), carry=("text", "source", "n_chars"))
    return got.where("lang_pred != 'und'").withColumnRenamed("lang_pred", "lang").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group whose 5-word shingles are alike by 0.8 or more: that of the smallest id, null last.

    Rows have numbers of their own here, as ids may be null or repeated.
    """
    rows = materialise(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("no")))
    groups = simhash.near_duplicate_groups(rows, "no").join(rows.select(F.col("no").alias("doc_id"), F.col("doc_id").alias("id")), "doc_id")
    first = groups.groupBy("group_id").agg(F.min(F.struct(F.col("id").isNull(), "id", "doc_id"))["doc_id"].alias("first"))
    gone = groups.join(first, "group_id").where("doc_id != first").select(F.col("doc_id").alias("no"))
    return rows.join(gone, "no", "left_anti").select(*COLUMNS)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts words of windows that an earlier document has; a document of which nothing is left goes."""
    got = substring.dedup_substrings(docs, carry=("lang", "source"))
    return got.where("n_words = 0 or n_removed < n_words").withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed_documents(docs).select(*COLUMNS)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of each row, with the digests of ids and of what they decode to."""
    return bpe.encode_documents(docs, bpe.default_tokenizer())


STAGES = [("language_id", language_id), ("simhash_near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("mixing", mixture), ("bpe", encoding)]

#: Sketches, models and seeded choices have no SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        last, docs = docs, materialise(stage(spark, docs, sf_dir))
        if i:
            discard(last)
    return STAGES[-1][1](spark, docs, sf_dir)
