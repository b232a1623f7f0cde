"""Thin queries: the given tables as the operators' records, and their results as digests."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog.registry import query
from . import twins
from .classes import score_captions
from .common import crc_rest
from .copies import find_near_copies
from .language import identify_language
from .leaks import find_leaks
from .linededup import SQL as LINE_SQL
from .linededup import dedup_lines
from .links import judge_links
from .outliers import screen_units
from .owners import own_texts
from .packing import pack_transcripts
from .prefixes import cue_ids, numbered, prefix_tree
from .rights import scan_rights
from .spelling import count_words, group_spellings
from .wrappers import extract_pages


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_license_scan")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence statements of every document, as rights texts of sources."""
    found = scan_rights(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("source_id"), "text"))
    starts = F.transform("places", lambda p: p["start_word"])
    return found.select(
        F.col("source_id").alias("doc_id"), "n_words", F.size("places").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        F.array_join("phrase_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), F.col("cover").alias("score"),
    )


@query("op2_decontamination", twins.LEAKS)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages in every document: documents as segments, items as held-out cases."""
    segments = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("segment_id"), "text")
    cases = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("case_id"), "text")
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end_word"] - s["start_word"])
    return find_leaks(segments, cases).select(
        F.col("segment_id").alias("doc_id"), "n_words", hit.alias("n_hit"), F.size("case_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("case_ids", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )


@query("op3_line_dedup", LINE_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, as transcripts of sources, without line chunks that occur before."""
    return dedup_lines(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("source_id"), "text")).withColumnRenamed("source_id", "doc_id")


@query("op4_quality_rules")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, as a scene unit's text of its source."""
    units = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("unit_id"), "text", "lang", F.col("source").alias("source_id"))
    return screen_units(units).select(
        F.col("unit_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        F.col("failed").alias("base_failed"), "kept", "distance",
    )


@query("op5_near_dedup", twins.COPIES)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near copies among all documents, as narration segments, on two-word shingles."""
    segments = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("segment_id"), "text")
    return find_near_copies(segments, words=2).withColumnRenamed("segment_id", "doc_id")


# The rules of the contract.
LINK_RULES = [
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"),
]


@query("op6_url_filter")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict for the url of every page."""
    links = table(spark, sf_dir, "pages").select(F.col("page_id").alias("link_id"), "url")
    return judge_links(links, LINK_RULES).select(F.col("link_id").alias("page_id"), "host", "path", "rule", "verdict", "matched", "confidence")


@query("op7_lm_scoring")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents, as captions, by models of four fifths of them."""
    docs = table(spark, sf_dir, "documents")
    captions = docs.select(F.col("doc_id").alias("caption_id"), "text", (crc_rest("doc_id", 5) != 1).alias("train"))
    return score_captions(captions).select(
        F.col("caption_id").alias("doc_id"), (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity",
    )


@query("op8_language_id")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from three quarters of them."""
    docs = table(spark, sf_dir, "documents").withColumn("held_out", crc_rest("doc_id", 4) == 2)
    cues = docs.select(F.col("doc_id").alias("cue_id"), "text", "lang", (~F.col("held_out")).alias("train"))
    return identify_language(cues).select(
        F.col("cue_id").alias("doc_id"), (crc_rest("cue_id", 4) == 2).alias("held_out"), "lang_pred", "score", "entropy", "rejected",
    )


@query("op9_html_extraction")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The article text of every page."""
    return extract_pages(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def packed(docs: DataFrame) -> DataFrame:
    """Packed pieces of documents, with a checksum of their ids."""
    pieces, places = pack_transcripts(docs.select(F.col("doc_id").alias("source_id"), "text"), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("row_no", F.col("source_id").alias("doc_id"), "piece", "start", "length", F.crc32("ids").alias("ids_crc32")).join(places, ["row_no", "piece"]).drop("row_no")


@query("op10_best_fit_packing")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, as transcripts, packed into sequences of 2048 tokens."""
    return packed(table(spark, sf_dir, "documents"))


def slipped(doc_id: int | None, found: Counter) -> Iterator[tuple[str, int]]:
    """The counted words of a document; one in 97 loses the letter that its checksum tells."""
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for word, n in found.items():
        h = zlib.crc32(word.encode(), start)
        yield (word if h % 97 else word[: h % len(word)] + word[h % len(word) + 1 :]), n


@query("op11_spelling_variants", twins.SPELLINGS)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants among the words of all documents, as cues."""
    cues = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("cue_id"), "text")
    return group_spellings(count_words(cues, slipped).withColumnRenamed("word", "text"))


@query("op12_exact_dedup", twins.OWNERS)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The document that stays of each group of equal texts: documents as cues."""
    return own_texts(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("cue_id"), "text")).withColumnRenamed("cue_id", "doc_id")


@query("op13_conversation_trie", twins.PREFIXES)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix tree of rebuilt conversations: conversations as sources, turns as cues.

    A conversation's first turns are those of the first of its twenty; how many, its id tells.
    """
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("source_id"), F.col("turn").alias("ord"), F.col("role").alias("speaker"), "text")
    placed = numbered(cue_ids(turns))
    convs = turns.where("source_id IS NOT NULL").select("source_id").distinct().select("source_id", (F.col("source_id") - F.col("source_id") % 20).alias("base"), crc_rest("source_id", 4).alias("h"))
    own = placed.where(F.col("pos") > crc_rest("source_id", 4)).select("source_id", F.col("pos").alias("ord"), "id")
    heads = placed.where("pos < 4 AND source_id % 20 = 0").select(F.col("source_id").alias("base"), F.col("pos").alias("ord"), "id")
    led = convs.join(heads, "base").where("ord <= h").select("source_id", "ord", "id")
    return prefix_tree(own.unionByName(led), convs).select(
        F.col("source_id").alias("conv_id"), "depth", F.col("parent_source_id").alias("parent_conv_id"), F.col("n_sources").alias("n_convs"),
        "n_children", "n_leaves", F.col("saved_words").alias("saved_tokens"), "ends_sha256",
    )
