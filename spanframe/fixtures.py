"""Adapters: the driver's tables seen as timed media tables.

Each adapter is a projection of whole tables that DuckDB can express too (see
``catalog/cte.py``); nothing is sampled, so the derived tables grow with the input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanframe.functions.clock import floor_div
from spanframe.functions.fingerprint import sha
from spanframe.plans.ordered import by_rows, positions, scan

FPS_NUM, FPS_DEN = 30000, 1001


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cents(c: str):
    return F.round(F.col(c) * 100).cast("bigint")


def micros(ts: str):
    return F.unix_micros(F.col(ts).cast("timestamp"))


def spans(spark, d) -> DataFrame:
    """Activity spans of users: one per event with a positive value."""
    return (
        table(spark, d, "events")
        .select(
            F.col("user_id").cast("string").alias("source_id"),
            F.col("event_id").alias("span_id"),
            micros("ts").alias("start_us"),
            (micros("ts") + cents("value") * 600_000).alias("end_us"),
            F.col("event_type").alias("kind"),
        )
        .where("end_us > start_us")
    )


def signals(spark, d) -> DataFrame:
    return table(spark, d, "events").select(
        F.col("user_id").cast("string").alias("source_id"),
        micros("ts").alias("t_us"),
        F.col("event_id").alias("row_id"),
        F.col("value"),
        F.col("event_type").alias("kind"),
    )


def sources(spark, d) -> DataFrame:
    c = F.col("c_custkey").cast("string")
    return table(spark, d, "customer").select(
        c.alias("source_id"),
        sha(c).alias("sha256"),
        ((F.col("c_nationkey") + 1) * 12_000_000).cast("bigint").alias("duration_us"),
        F.lit(1920).cast("bigint").alias("width"),
        F.lit(1080).cast("bigint").alias("height"),
        F.lit(FPS_NUM).cast("bigint").alias("fps_num"),
        F.lit(FPS_DEN).cast("bigint").alias("fps_den"),
        (F.col("c_nationkey") % 5 != 0).alias("has_audio"),
        F.col("c_custkey").alias("ord"),
    )


def cues(spark, d) -> DataFrame:
    c = table(spark, d, "conversations").select(
        F.col("conv_id").cast("string").alias("source_id"),
        F.col("turn").cast("bigint").alias("ord"),
        F.col("role").alias("speaker"),
        F.col("text"),
        (F.greatest(F.length("text"), F.lit(1)) * 60_000).cast("bigint").alias("len"),
    )
    c = scan(c, ["source_id"], ["ord"], by_rows("ord"), sums={"end_us": F.col("len")})
    return c.select(
        "source_id", "ord",
        F.concat_ws(":", "source_id", "ord").alias("cue_id"),
        (F.col("end_us") - F.col("len")).alias("start_us"),
        "end_us", "speaker", "text",
    )


LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate", "l_discount", "l_tax"]


def lines(spark, d, key: str = "l_orderkey") -> DataFrame:
    """lineitem with a dense position per order (the given key repeats).

    ``key`` names the order: ``l_orderkey``, or a column of its text for tables that are
    keyed by it, so that their rows lie by that key at once.
    """
    li = table(spark, d, "lineitem")
    if key != "l_orderkey":
        li = li.withColumn(key, F.col("l_orderkey").cast("string"))
    block = F.col("l_linenumber").cast("bigint") * 1_000_000_000 + floor_div("l_partkey", F.lit(4096))
    return positions(li, [key], LINE_ORDER, block, "ord")


def clips(spark, d) -> DataFrame:
    s = F.col("l_suppkey") * 250_000
    return lines(spark, d, "work_id").select(
        "work_id",
        "ord",
        F.concat_ws("c", "work_id", "ord").alias("clip_id"),
        (F.col("l_partkey") % 50).cast("string").alias("source_id"),
        s.cast("bigint").alias("start_us"),
        (s + F.col("l_quantity").cast("bigint") * 400_000).cast("bigint").alias("end_us"),
        F.when(F.col("l_returnflag") == "N", 3).otherwise(1).cast("bigint").alias("speed_num"),
        F.when(F.col("l_returnflag") == "A", 1).otherwise(2).cast("bigint").alias("speed_den"),
        (-F.round(F.col("l_discount") * 100)).cast("bigint").alias("gain_db"),
        (F.col("l_linestatus") == "F").alias("mute"),
        F.lit(FPS_NUM).cast("bigint").alias("fps_num"),
        F.lit(FPS_DEN).cast("bigint").alias("fps_den"),
    )


def segments(spark, d) -> DataFrame:
    """Storyboard segments: the orders of a customer in date order."""
    o = table(spark, d, "orders")
    day = F.unix_date(F.col("o_orderdate").cast("date"))
    o = positions(o.withColumn("day", day), ["o_custkey"], ["day", "o_orderkey"], floor_div(F.col("day").cast("bigint"), F.lit(7)), "ord")
    c = cents("o_totalprice")
    voice = F.when((F.col("o_orderstatus") != "F") & (c % 7 != 0), (c % 30_000 + 500) * 1000)
    return o.select(
        F.col("o_custkey").cast("string").alias("work_id"),
        "ord",
        F.col("o_orderkey").cast("string").alias("segment_id"),
        (F.col("o_orderkey") % 25).cast("string").alias("beat_id"),
        F.when(F.col("o_orderstatus") == "F", "original").otherwise("voiceover").alias("mode"),
        F.col("o_orderpriority").alias("text"),
        ((c % 20_000 + 1000) * 1000).alias("planned_us"),
        voice.alias("voice_us"),
        (F.col("o_orderkey") % 11 == 0).alias("allow_reuse"),
    )


def visuals(spark, d) -> DataFrame:
    """Ordered source references of each segment."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey"))
    s = F.col("l_suppkey") * 250_000
    return lines(spark, d).join(o, "l_orderkey").select(
        F.col("o_custkey").cast("string").alias("work_id"),
        F.col("l_orderkey").cast("string").alias("segment_id"),
        "ord",
        (F.col("l_partkey") % 50).cast("string").alias("source_id"),
        s.cast("bigint").alias("start_us"),
        (s + F.col("l_quantity").cast("bigint") * 400_000).cast("bigint").alias("end_us"),
        F.concat(F.lit("u"), F.col("l_partkey")).alias("unit_id"),
    )


def units(spark, d) -> DataFrame:
    """Scene units: documents placed on the clock of their source."""
    i = F.col("doc_id")
    return table(spark, d, "documents").select(
        F.col("source").alias("source_id"),
        i.cast("string").alias("unit_id"),
        (i * 1_000_000).cast("bigint").alias("start_us"),
        (i * 1_000_000 + 4_000_000 + (i * 7919) % 12_000_000).cast("bigint").alias("end_us"),
        F.col("text"),
        ((i * 37) % 100).cast("bigint").alias("motion"),
        ((i * 53) % 100).cast("bigint").alias("speech"),
        F.col("lang"),
    )


def beats(spark, d) -> DataFrame:
    i = F.col("item_id")
    return table(spark, d, "benchmark").select(
        F.floor(i / 10).cast("string").alias("work_id"),
        i.cast("string").alias("beat_id"),
        i.alias("ord"),
        F.col("text"),
    )


def beat_spans(spark, d) -> DataFrame:
    """Source ranges of the events behind each beat."""
    i = F.col("item_id")
    return table(spark, d, "benchmark").select(
        F.floor(i / 10).cast("string").alias("work_id"),
        i.cast("string").alias("beat_id"),
        F.concat(F.lit("src"), i % 20).alias("source_id"),
        (i * 10_000_000).cast("bigint").alias("start_us"),
        (i * 10_000_000 + 60_000_000).cast("bigint").alias("end_us"),
    )


def candidates(spark, d) -> DataFrame:
    """Highlight candidates: event spans scored per user."""
    e = table(spark, d, "events")
    i, v = F.col("event_id"), cents("value")
    return e.select(
        F.col("user_id").cast("string").alias("work_id"),
        i.cast("string").alias("highlight_id"),
        F.col("event_id").alias("ord"),
        (i % 3).cast("string").alias("source_id"),
        F.floor(micros("ts") / 60_000_000).cast("bigint").alias("start_us"),
        (F.floor(micros("ts") / 60_000_000) + v + 300).cast("bigint").alias("end_us"),
        F.col("event_type").alias("type"),
        F.concat(F.lit("p"), i % 4).alias("character"),
        ((v * 7919 + i * 104729) % 1_000_003).alias("score"),
        ((i * 31) % 100).alias("confidence"),
        ((i * 17) % 50).alias("redundancy"),
    )


def samples(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").select(
        F.col("vec_id").cast("string").alias("source_id"), F.col("embedding").alias("x"), F.col("label")
    )


def revisions(spark, d) -> DataFrame:
    """A revision log per customer: one entry per order, digests of the order row."""
    s = segments(spark, d)
    digest = F.sha2(F.concat_ws("|", "segment_id", "text", "planned_us"), 256)
    return s.select(
        "work_id", F.col("ord").alias("seq"), (F.col("ord") - 1).alias("parent"), digest.alias("digest"),
        F.when(F.col("mode") == "original", "restore").otherwise("commit").alias("action"),
        F.col("segment_id").alias("doc"),
    )


def ledger(spark, d) -> DataFrame:
    """Billing events: lines of an order in position order, keyed per order and part."""
    return lines(spark, d, "task_id").select(
        "task_id",
        F.concat_ws("-", "task_id", F.col("l_partkey") % 40).alias("event_key"),
        F.col("ord").alias("seq"),
        (cents("l_extendedprice") * 10_000).alias("amount_micros"),
        F.sha2(F.concat_ws("|", F.col("l_partkey") % 40, F.col("l_suppkey") % 3), 256).alias("body_sha"),
    )


def roster(spark, d) -> DataFrame:
    doc = table(spark, d, "documents")
    return doc.select(
        F.col("doc_id").cast("string").alias("case_id"),
        F.col("source").alias("family"),
        F.col("lang").alias("stratum"),
        F.concat(F.lit("W"), F.col("doc_id") % 16).alias("package"),
        (F.col("doc_id") % 9 == 0).alias("critical"),
        (F.col("doc_id") % 10 != 3).alias("in_scope"),
        (F.col("doc_id") % 4 == 1).alias("full_production"),
    )


def scores(spark, d) -> DataFrame:
    """Review scores: labelled documents."""
    lab = table(spark, d, "labels")
    return lab.select(
        F.col("doc_id").cast("string").alias("case_id"),
        F.concat(F.lit("r"), F.col("doc_id")).alias("run_id"),
        (F.col("quality") == 1).alias("scope_declared"),
        (F.col("toxic") == 0).alias("routing_correct"),
        ((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("execution_accepted"),
        ((F.col("quality") == 1) & (F.col("doc_id") % 3 == 0)).alias("production_usable"),
        (F.col("quality") == 1).alias("critical_pass"),
    )
