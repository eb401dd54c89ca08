"""From raw documents to packed batches: language, near-duplicates, contamination, personal data, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lossweave.llm import decontaminate, langid, length_buckets, minhash_paths, pii
from lossweave.llm.staging import stage

#: Share of a document's letters that its language must cover.
LANGUAGE_SHARE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with one prevailing language; those without letters or with no language for half of them go.

    Learned from the labelled documents that are not held out; without any, no
    document has a language and all go.  Null and empty texts go.  Repeated rows
    share one fate; further columns pass, whatever their names; no rows, no rows.
    """
    return langid.prevailing(docs, langid.fit(docs), LANGUAGE_SHARE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates on 5-word shingles at a similarity of 0.8: the smallest id.

    Texts without words, null ones included, and rows without an id are kept.
    Rows of one id are one document and stay or go together.  Further columns
    pass, whatever their names; no rows, no rows.
    """
    return minhash_paths.drop_near_duplicates(docs, shingle=5, similarity=80)


def contamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth is benchmark text.

    Null and empty texts hold none and are kept, as are all if the benchmark is
    empty.  Repeated rows share one fate; rows of one id but other texts are
    judged apart.  Further columns pass, whatever their names; no rows, no rows.
    """
    return decontaminate.remove_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents with personal data replaced by its kind in angle brackets; no row goes.

    Null and empty texts stay as they are.  Repeated rows are changed alike.
    Further columns pass, whatever their names; no rows, no rows.
    """
    return pii.redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents, each with its place in the batches of its length bucket.

    Null and empty texts have no tokens and stand in the first bucket.  Repeated
    rows each take a slot.  Further columns pass, but those named as a place's
    give way; no rows, no rows.
    """
    return length_buckets.places(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("contamination", contamination), ("personal_data", personal_data), ("packing", packing)]

# Language identification has no SQL; the pipeline is tested against a plain version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again; the last one's rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, apply in STAGES:
        docs = stage(apply(spark, docs, sf_dir), name)
    return docs
