"""A corpus from raw documents to packed token windows, in stages that are written and read again.

Each stage takes the documents its predecessor kept. All but the last return the columns of
documents; extra columns pass through untouched, repeated and null ids are safe, and an empty
table stays empty.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leverscope.llm import common, decontamination, language, near_duplicates, packing, privacy
from leverscope.llm.queries import VOCABULARY


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that look like one of the corpus' languages; lang becomes the language found.

    Null texts, texts without a letter and texts unlike any learned language go.
    """
    return language.keep_identified(docs, language.learn(docs))


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """The rows with a number that stays the same over scans: from file and place, or written with them."""
    own = f"row_{uuid.uuid4().hex}"  # clashes with no column
    try:
        return docs.select("*", F.xxhash64("_metadata.file_path", "_metadata.row_index").alias(own)), own
    except AnalysisException:  # not read from files
        return common.stored(docs.withColumn(own, F.monotonically_increasing_id()), "stage-rows"), own


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, similarity 0.8 or more): the one of least doc_id.

    Of rows that repeat an id within a group, one stays. Rows whose number a bitmap shows not to be
    dropped pass at once; only the others are joined with the dropped numbers.
    """
    rows, own = _numbered(docs)
    found = near_duplicates.near_duplicates(rows, row=own)
    dropped = common.stored(found.filter("not kept").select("row"), "stage-dropped")
    sieve, at = common.Sieve(dropped), len(docs.columns)

    def passing(wanted: bool):
        return lambda: lambda batch: batch.filter(pa.array(sieve.maybe(batch.column(at).to_numpy()) == wanted))

    doubtful = common.mapped(rows, passing(True)).join(dropped.withColumnRenamed("row", own), own, "left_anti")
    kept = common.mapped(rows, passing(False))
    return kept.drop(own).union(doubtful.select(*kept.columns).drop(own))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item within its edit budget."""
    return decontamination.without_leaks(docs, common.table(spark, sf_dir, "benchmark"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind in brackets; n_chars follows the new text."""
    return privacy.redact(docs, privacy.learn(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed windows with their ids: one row per piece."""
    return packing.pack(docs, VOCABULARY)


STAGES = [
    ("language ID", language_id),
    ("MinHash near-dedup", minhash_near_dedup),
    ("benchmark decontamination", decontaminate),
    ("PII", redact),
    ("packing", pack),
]

# Centroids, the random field and the tokenizer have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages on documents, each written as Parquet to the shared folder and read as the next one's docs."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
