"""Sinks: captions, cut lists, findings, scripts and interchange files.

Line-oriented sinks range-partition and sort their rows, so a very large work is
written as several ordered part files.  Only an interchange document is one JSON value
per work, because its format is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanframe.functions.clock import clock_text, us_to_ms
from spanframe.plans import findings as fd
from spanframe.plans.ordered import by_rows, by_time, positions, scan


def srt_rows(cues: DataFrame, rounding: str = "up") -> tuple[DataFrame, DataFrame]:
    """SNK1: numbered caption blocks, and findings for cues that round to nothing.

    ``cues``: work_id, cue_id, start_us, end_us, text.
    """
    c = cues.withColumn("m0", us_to_ms("start_us", rounding)).withColumn("m1", us_to_ms("end_us", rounding))
    unfit = F.contains("text", F.lit("\n\n")) | F.contains("text", F.lit("\r")) | F.contains("text", F.lit("-->"))
    bad = fd.checks(c, [("CUE_TOO_SHORT_FOR_SRT", F.col("m1") <= F.col("m0")), ("CAPTION_NOT_REPRESENTABLE_AS_SRT", unfit)], entity="cue_id")
    ok = c.where(F.col("m1") > F.col("m0")).where(~unfit)
    ok = positions(ok, ["work_id"], ["start_us", "end_us", "cue_id"], by_time("start_us"), "pos")
    block = F.concat(F.col("pos"), F.lit("\n"), clock_text("m0"), F.lit(" --> "), clock_text("m1"), F.lit("\n"), F.col("text"), F.lit("\n"))
    return ok.select("work_id", "pos", "cue_id", F.col("m0").alias("start_ms"), F.col("m1").alias("end_ms"), block.alias("block")), bad


def _chunks(rows: DataFrame, text: str, joiner: str, size: int) -> DataFrame:
    """Texts of at most ``size`` consecutive rows of a work, so no work is one value."""
    g = rows.withColumn("chunk", F.call_function("div", F.col("pos") - 1, F.lit(size))).groupBy("work_id", "chunk")
    g = g.agg(F.array_sort(F.collect_list(F.struct(F.col("pos").alias("o"), F.col(text).alias("t")))).alias("l"))
    return g.select("work_id", "chunk", F.array_join(F.transform("l", lambda x: x["t"]), joiner).alias("value"))


def _write_lines(rows: DataFrame, order: list[str], text: str, path: str) -> None:
    """Ordered text per work: a large work spans several part files in order."""
    r = rows.repartitionByRange("work_id", *order).sortWithinPartitions("work_id", *order)
    r.select("work_id", F.col(text).alias("value")).write.mode("errorifexists").partitionBy("work_id").text(path)


def srt_text(cues: DataFrame, rounding: str = "up", size: int = 1000) -> DataFrame:
    """SNK1: SRT texts of each work in chunks of ``size`` cues."""
    return _chunks(srt_rows(cues, rounding)[0], "block", "\n", size)


def write_srt(cues: DataFrame, path: str, rounding: str = "up") -> None:
    _write_lines(srt_rows(cues, rounding)[0], ["pos"], "block", path)


def edl_rows(edl: DataFrame, segments: DataFrame) -> DataFrame:
    """SNK2: one JSON line per segment with its played source spans in order."""
    span = F.struct("ord", "source_id", "start_us", "end_us", "out_start_us", "out_end_us", "unit_id")
    s = edl.groupBy("work_id", "segment_id").agg(F.array_sort(F.collect_list(span)).alias("source_spans"))
    j = segments.select("work_id", "segment_id", F.col("ord").alias("seg_ord"), "mode", "text").join(s, ["work_id", "segment_id"], "left")
    return j.select("work_id", "seg_ord", F.to_json(F.struct("seg_ord", "segment_id", "mode", "text", "source_spans")).alias("line"))


def write_edl(edl: DataFrame, segments: DataFrame, path: str) -> None:
    _write_lines(edl_rows(edl, segments), ["seg_ord"], "line", path)


def write_findings(findings: DataFrame, path: str, mode: str = "append") -> None:
    """SNK3: findings as Parquet, one folder per rule."""
    findings.write.mode(mode).partitionBy("rule_id").parquet(path)


def script_rows(segments: DataFrame, visuals: DataFrame) -> DataFrame:
    """SNK4: numbered reading script lines with the first source range of a segment."""
    v = visuals.groupBy("work_id", "segment_id").agg(F.min_by(F.struct("source_id", "start_us", "end_us"), "ord").alias("v"))
    s = positions(segments, ["work_id"], ["ord"], by_rows("ord"), "pos").join(v, ["work_id", "segment_id"], "left")
    label = F.when(F.col("mode") == "voiceover", "解说").otherwise("原片")
    at = F.when(F.col("v").isNotNull(), F.format_string(" `%s %.2f-%.2fs`", "v.source_id", F.col("v.start_us") / 1e6, F.col("v.end_us") / 1e6)).otherwise("")
    head = F.concat(F.lit("## "), F.lpad(F.col("pos").cast("string"), 2, "0"), F.lit(". ["), label, F.lit("] "), F.col("segment_id"), at)
    return s.select("work_id", "pos", F.concat(head, F.lit("\n\n"), F.col("text"), F.lit("\n")).alias("line"))


def write_script(segments: DataFrame, visuals: DataFrame, path: str) -> None:
    _write_lines(script_rows(segments, visuals), ["pos"], "line", path)


def interchange_items(tracks: DataFrame, within: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """SNK5: track items with gap rows where a clip starts later than its predecessor
    ends, and findings for overlaps.

    ``tracks``: work_id, track_id, kind, instance_id, resource_id, start_us, duration_us,
    target_start_us.  ``within``: see :func:`scan`, by work and track.
    """
    key = ["work_id", "track_id"]
    t = scan(tracks, key, ["target_start_us", "instance_id"], by_time("target_start_us"), lags={"__p": F.col("target_start_us") + F.col("duration_us")}, within=within)
    t = t.withColumn("__p", F.coalesce("__p", F.lit(0)))
    bad = fd.checks(t, [("OVERLAPPING_TRACK_CLIP", F.col("target_start_us") < F.col("__p")), ("EMPTY_TRACK_CLIP", F.col("duration_us") <= 0)], entity="instance_id")
    clip = t.select(*key, "kind", F.lit("Clip.2").alias("schema"), "instance_id", "resource_id", "start_us", "duration_us", "target_start_us")
    gap = t.where("target_start_us > __p").select(*key, "kind", F.lit("Gap.1").alias("schema"), F.lit(None).cast("string").alias("instance_id"), F.lit(None).cast("string").alias("resource_id"), F.lit(0).cast("bigint").alias("start_us"), (F.col("target_start_us") - F.col("__p")).alias("duration_us"), F.col("__p").alias("target_start_us"))
    return clip.unionByName(gap), bad


def interchange_json(tracks: DataFrame) -> DataFrame:
    """SNK5: one interchange document per work, readable by the interchange reader."""
    items = interchange_items(tracks)[0]
    c = F.struct("target_start_us", F.col("schema"), "instance_id", "resource_id", "start_us", "duration_us", F.lit(True).alias("enabled"))
    k = items.groupBy("work_id", "track_id", "kind").agg(F.array_sort(F.collect_list(c)).alias("children"))
    return k.groupBy("work_id").agg(F.to_json(F.struct(F.array_sort(F.collect_list(F.struct("track_id", "kind", "children"))).alias("tracks"))).alias("value"))


def write_interchange(tracks: DataFrame, path: str) -> None:
    interchange_json(tracks).write.mode("errorifexists").partitionBy("work_id").text(path)
