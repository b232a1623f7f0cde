"""From documents to packed training sequences: five stages, each on all that the one before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanframe.catalog.registry import query
from spanframe.llm.common import discard, joinable, written
from spanframe.llm.copies import find_near_copies
from spanframe.llm.language import identify_language
from spanframe.llm.leaks import find_leaks
from spanframe.llm.linededup import dedup_lines
from spanframe.llm.packing import pack_transcripts

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


ID_ROWS = 1_000_000  # ids that are sent to the documents; more meet them by key


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents whose doc_id is not among ``ids``."""
    gone = written(ids.select("doc_id").distinct(), "gone")
    return docs.select(*COLUMNS).join(joinable(gone, ID_ROWS), "doc_id", "left_anti").select(*COLUMNS)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones teach; those that are rejected go.

    A document without text or letters is rejected. In all stages doc_id is the key: rows
    that share one are decided together, and a row without one always stays.
    """
    found = identify_language(docs.select(F.col("doc_id").alias("cue_id"), "text", "lang", F.col("lang").isNotNull().alias("train")))
    return without(docs, found.where("rejected").withColumnRenamed("cue_id", "doc_id"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without line chunks that occur before; a document of which no line with a word is left goes."""
    cut = dedup_lines(docs.select(F.col("doc_id").alias("source_id"), "text", "lang", "source"), carried=["lang", "source"])
    left = cut.where("n_left > 0 OR n_removed = 0").withColumnRenamed("source_id", "doc_id").withColumn("n_chars", F.length("text").cast("long"))
    return left.select(*COLUMNS)


def copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8."""
    found = find_near_copies(docs.select(F.col("doc_id").alias("segment_id"), "text"), words=5, similarity=80)
    return without(docs, found.where("NOT kept").withColumnRenamed("segment_id", "doc_id"))


def leak_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that repeat no passage of the benchmark."""
    cases = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("case_id"), "text")
    found = find_leaks(docs.select(F.col("doc_id").alias("segment_id"), "text"), cases)
    return without(docs, found.where("size(spans) > 0").withColumnRenamed("segment_id", "doc_id"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in sequences of at most 2048: each piece with its sequence, place and ids."""
    pieces, places = pack_transcripts(docs.select(F.col("doc_id").alias("source_id"), "text"), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.join(places, ["row_no", "piece"]).select(
        F.col("source_id").alias("doc_id"), "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset", "ids",
    )


STAGES = [
    ("language ID", language_stage),
    ("line dedup", line_stage),
    ("MinHash near-dedup", copies_stage),
    ("benchmark decontamination", leak_stage),
    ("best-fit packing", packing_stage),
]

ORACLE_SQL = None  # models, sketches and packing have no SQL form; tests compare the stages with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table, each written before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        last, docs = docs, written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if k:
            discard(last)
    return STAGES[-1][1](spark, docs, sf_dir)


query("pipeline")(run)
