"""The corpus pipeline: language ID, exact and near deduplication, personal data, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelgate.llm import langid, pii
from voxelgate.llm.common import checkpoint, table
from voxelgate.llm.exact_dedup import exact_dedup
from voxelgate.llm.ngram_join import near_groups
from voxelgate.llm.packing import pack
from voxelgate.llm.queries import tokenizer_path

#: Ids to drop are broadcast up to so many (8 MB); beyond it they are joined by a shuffle.
_BROADCAST_IDS = 1_000_000


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language is rejected: no letter (so null and empty texts too), or a narrow margin, of which a tie is one.

    Rows with null ids and repeated rows are treated like any; very long texts are coded whole; an
    empty table stays empty.
    """
    model = langid.fit(docs)
    return langid.identify(docs, model, carry=tuple(docs.columns)).filter(~F.col("rejected")).select("row.*")


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of equal texts, the one with the smallest id; a null id counts as larger than any.

    Of repeated rows one stays. A null text counts as empty; an empty table stays empty.
    """
    return exact_dedup(docs, carry=docs.columns).filter("kept").select("row.*")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of linked texts, the one with the smallest id.

    Rows that repeat an id are one document and stay or go together; rows with a null id, a null
    text or a blank one have no links and stay. An empty table stays empty.
    """
    dropped = checkpoint(near_groups(docs).filter("component <> id").select(F.col("id").alias("doc_id")).distinct())
    few = dropped.count() <= _BROADCAST_IDS
    return docs.join(F.broadcast(dropped) if few else dropped, "doc_id", "left_anti").select(docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in the texts by its kind and counts n_chars anew; a null text stays null, and rows of any kind stay."""
    clean = pii.redact(docs, pii.fit(docs))
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences; a null text counts as empty, repeated rows are packed once each, an empty table gives no pieces."""
    # the workers share the executors' memory with what the stages before have left in the JVM
    pieces = pack(docs, tokenizer_path("word_bpe_49k.json"), cached_words=60_000)
    return pieces.select("row.doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset")


STAGES = [("language_id", language_id), ("exact_dedup", exact_copies), ("ngram_join", near_copies), ("pii", personal_data), ("packing", packing)]

#: Neither compression nor tokenization can be written in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = checkpoint(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
