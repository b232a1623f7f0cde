"""Readers: subtitle files, work documents, measurement logs, interchange files.

Each ``read_*`` scans files and calls a ``parse_*`` that works on a table of whole file
texts (``path``, ``value``), so texts from any other source can be parsed too.  One
file is one row; files are parsed independently.  Measurement logs are read by lines, so a
long one is cut over many tasks, and files are hashed piece by piece.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanframe.functions import fixed
from spanframe.functions import text as tx
from spanframe.plans import findings as fd
from spanframe.plans.bins import BIN_US, interval_join
from spanframe.plans.ordered import by_rows, scan

CLOCK = r"((?:\d{1,2}:)?\d{1,2}:\d{2}[,.]\d{1,3})"
STRICT = r"^(\d{2,}):(\d{2}):(\d{2}),(\d{3}) --> (\d{2,}):(\d{2}):(\d{2}),(\d{3})$"
BLANK = r"\n\s*\n"


def _texts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")


def _unix(c):
    c = F.regexp_replace(c, "^﻿", "")
    return F.replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def clock_us(c):
    """``[HH:]MM:SS[.,]fff`` to microseconds."""
    p = F.split(F.replace(c, F.lit(","), F.lit(".")), ":")
    n = F.size(p)
    sec = F.round(F.element_at(p, -1).cast("decimal(18,6)") * 1_000_000).cast("bigint")
    hours = F.when(n >= 3, F.try_element_at(p, -F.lit(3)).cast("bigint")).otherwise(0)
    return (hours * 3600 + F.element_at(p, -2).cast("bigint") * 60) * 1_000_000 + sec


# -- SRC1 -------------------------------------------------------------------------


PIECE = 1 << 20  # bytes of a file that are hashed at once


def _store(path: str) -> tuple[fs.FileSystem, str]:
    """The store of a file and its name there."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(quote(path, safe=":/@"))


def register_sources(spark: SparkSession, glob: str) -> DataFrame:
    """SRC1: path, size and SHA-256 of files.

    Spark lists the files, but for empty ones; a task streams its own ones through the hash in pieces of
    ``PIECE`` bytes, whatever their size.  On a store that only Spark's readers can open, a
    file is one value of theirs, at most 2 GB.
    """
    files = spark.read.format("binaryFile").load(glob)
    first = files.select("path").first()
    try:
        if first is not None:
            _store(first.path)
    except (pa.ArrowInvalid, OSError):
        return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path in b.column("path").to_pylist():
                digest, size = hashlib.sha256(), 0
                store, name = _store(path)
                with store.open_input_stream(name, compression=None) as stream:
                    while piece := stream.read(PIECE):
                        digest.update(piece)
                        size += len(piece)
                rows.append({"path": path, "bytes": size, "sha256": digest.hexdigest()})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("path", pa.string()), ("bytes", pa.int64()), ("sha256", pa.string())]))

    return files.select("path").mapInArrow(hashed, "path string, bytes bigint, sha256 string")


def verify_sources(sources: DataFrame, declared: DataFrame) -> DataFrame:
    """SRC1: declared references against the registry."""
    j = declared.join(sources.select("path", F.col("sha256").alias("__s"), F.col("bytes").alias("__b")), "path", "left")
    return fd.checks(
        j, [("SOURCE_NOT_FOUND", F.col("__s").isNull()), ("SOURCE_HASH_MISMATCH", F.col("__s") != F.col("sha256")), ("SOURCE_SIZE_MISMATCH", F.col("__b") != F.col("bytes"))],
        work=F.lit("sources"), entity="path",
    )


# -- SRC2, SRC3, SRC4 ---------------------------------------------------------------


def parse_srt(texts: DataFrame) -> DataFrame:
    """SRC2: SRT or WebVTT text to cues; empty or reversed cues are dropped."""
    blocks = texts.select("path", F.posexplode(F.split(_unix(F.col("value")), BLANK)).alias("b", "block"))
    lines = F.filter(F.transform(F.split("block", "\n"), lambda s: tx.strip(s)), lambda s: s != "")
    blocks = blocks.withColumn("l", lines).withColumn("t", F.array_position(F.transform("l", lambda s: F.contains(s, F.lit("-->"))), True))
    stamp = F.get("l", (F.col("t") - 1).cast("int"))
    hit = F.regexp_extract(stamp, CLOCK + r"\s*-->\s*" + CLOCK, 0)
    c = blocks.where("t > 0").withColumn("hit", hit).where("hit <> ''")
    body = F.array_join(F.slice("l", F.col("t").cast("int") + 1, F.greatest(F.size("l") - F.col("t").cast("int"), F.lit(0))), " ")
    side = lambda g: clock_us(F.regexp_extract("hit", CLOCK + r"\s*-->\s*" + CLOCK, g))
    c = c.select("path", F.col("b").cast("bigint").alias("block"), side(1).alias("start_us"), side(2).alias("end_us"), tx.clean_text(body).alias("text"))
    return c.where("text <> '' and end_us > start_us")


def read_srt(spark: SparkSession, path: str) -> DataFrame:
    return parse_srt(_texts(spark, path))


def parse_ass(texts: DataFrame) -> DataFrame:
    """SRC3: ASS/SSA dialogue rows under the nearest earlier ``Format:`` header."""
    rows = texts.select("path", F.posexplode(F.split(_unix(F.col("value")), "\n")).alias("n", "raw")).withColumn("line", tx.strip("raw"))
    is_f, is_d = F.lower("line").startswith("format:"), F.lower("line").startswith("dialogue:")
    names = F.transform(F.split(F.regexp_replace("line", r"^[^:]*:", ""), ","), lambda s: F.lower(tx.strip(s)))
    rows = rows.where(is_f | is_d).withColumn("fmt", F.when(is_f, F.struct(F.col("n"), names.alias("f"))))
    rows = scan(rows, ["path"], ["n"], by_rows("n"), maxes={"__f": F.col("fmt")}).where(is_d)
    plain = F.array(*[F.lit(x) for x in ("layer", "start", "end", "style", "name", "marginl", "marginr", "marginv", "effect", "text")])
    rows = rows.withColumn("f", F.coalesce("__f.f", plain)).withColumn("body", F.ltrim(F.regexp_replace("line", r"^[^:]*:", "")))
    parts = F.split("body", ",", -1)
    k = F.size("f")
    rows = rows.withColumn("p", parts).where(F.size("p") >= k)
    # Spark may cut the parts before it drops short rows, headers among them: no length is below 0
    rows = rows.withColumn("p", F.concat(F.slice("p", F.lit(1), k - 1), F.array(F.array_join(F.slice("p", k, F.greatest(F.size("p") - k + 1, F.lit(0))), ","))))
    cell = lambda name: F.try_element_at("p", F.nullif(F.array_position("f", name).cast("int"), F.lit(0)))
    rows = rows.select("path", F.col("n").cast("bigint").alias("block"), tx.strip(cell("start")).alias("a"), tx.strip(cell("end")).alias("z"), cell("text").alias("x")).where("a <> '' and z <> '' and x is not null")
    return rows.select("path", "block", clock_us("a").alias("start_us"), clock_us("z").alias("end_us"), tx.clean_text("x").alias("text")).where("text <> '' and end_us > start_us")


def read_ass(spark: SparkSession, path: str) -> DataFrame:
    return parse_ass(_texts(spark, path))


def parse_srt_strict(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SRC4: cues of a delivered SRT file, and one finding per malformed block."""
    v = tx.strip(_unix(F.col("value")))
    b = texts.where(v != "").select("path", F.posexplode(F.split(v, BLANK)).alias("b", "block")).withColumn("l", F.split("block", "\n"))
    stamp = tx.strip(F.get("l", F.lit(1)))
    b = b.withColumn("stamp", stamp)
    g = lambda i: F.nullif(F.regexp_extract("stamp", STRICT, i), F.lit("")).cast("bigint")
    ms = lambda o: ((g(o) * 60 + g(o + 1)) * 60 + g(o + 2)) * 1000 + g(o + 3)
    text = tx.strip(F.array_join(F.slice("l", F.lit(3), F.greatest(F.size("l") - 2, F.lit(0))), "\n"))
    b = b.withColumn("start_us", ms(1) * 1000).withColumn("end_us", ms(5) * 1000).withColumn("text", text)
    rule = (
        F.when((F.size("l") < 3) | ~tx.strip(F.get("l", F.lit(0))).rlike(r"^\d+$"), "SRT_BLOCK_INCOMPLETE")
        .when(~F.col("stamp").rlike(STRICT), "SRT_TIMING_INVALID")
        .when((g(2) >= 60) | (g(3) >= 60) | (g(6) >= 60) | (g(7) >= 60), "SRT_CLOCK_OUT_OF_RANGE")
        .when((F.col("end_us") <= F.col("start_us")) | (F.col("text") == ""), "SRT_CUE_EMPTY")
    )
    b = b.withColumn("rule", rule)
    bad = fd.finding(b.withColumn("__r", F.col("rule")), F.col("__r"), F.col("rule").isNotNull(), F.concat_ws("#", "path", "b"), work="path")
    return b.where("rule is null").select("path", (F.col("b") + 1).cast("bigint").alias("pos"), "start_us", "end_us", "text"), bad


def read_srt_strict(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return parse_srt_strict(_texts(spark, path))


# -- SRC5 -------------------------------------------------------------------------

WORK_SCHEMA = (
    "work_id string, plan struct<fps_num:bigint,fps_den:bigint,width:int,height:int,clips:array<struct<id:string,source_id:string,start_us:bigint,end_us:bigint,"
    "gain_db:double,mute:boolean,speed_num:bigint,speed_den:bigint>>>, captions map<string,struct<clip_id:string,start_us:bigint,end_us:bigint,text:string>>, "
    "audio_tracks map<string,struct<source_id:string,start_us:bigint,end_us:bigint,anchor_clip_id:string,offset_us:bigint,gain_db:double>>, notes map<string,string>"
)


def parse_works(texts: DataFrame) -> dict[str, DataFrame]:
    """SRC5: work documents (JSON with id-keyed maps) to one table per section."""
    d = texts.select(F.from_json("value", WORK_SCHEMA, {"mode": "PERMISSIVE"}).alias("d")).select("d.*")
    clips = d.select("work_id", "plan.fps_num", "plan.fps_den", F.posexplode("plan.clips").alias("p", "c"))
    clips = clips.select("work_id", (F.col("p") + 1).cast("bigint").alias("ord"), F.col("c.id").alias("clip_id"), "c.source_id", "c.start_us", "c.end_us", "c.gain_db", F.coalesce("c.mute", F.lit(False)).alias("mute"),
                         F.coalesce("c.speed_num", F.lit(1)).alias("speed_num"), F.coalesce("c.speed_den", F.lit(1)).alias("speed_den"), "fps_num", "fps_den")
    cap = d.select("work_id", F.explode("captions").alias("caption_id", "c")).select("work_id", "caption_id", "c.*")
    trk = d.select("work_id", F.explode("audio_tracks").alias("track_id", "c")).select("work_id", "track_id", "c.*")
    notes = d.select("work_id", F.explode("notes").alias("note_id", "text"))
    works = d.select("work_id", "plan.fps_num", "plan.fps_den", "plan.width", "plan.height")
    return {"works": works, "clips": clips, "captions": cap, "tracks": trk, "notes": notes}


def read_works(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return parse_works(_texts(spark, path))


# -- SRC6 to SRC9 -----------------------------------------------------------------


def validate_words(words: DataFrame, sources: DataFrame, tol_us: int = 1) -> DataFrame:
    """SRC6: unique ids, text, speaker, range, order and confidence of word rows."""
    n = words.groupBy("source_id", "word_id").agg(F.count(F.lit(1)).alias("n"))
    w = scan(words, ["source_id"], ["ord"], by_rows("ord"), lags={"__p": F.col("start_us")}).join(sources.select("source_id", "duration_us"), "source_id", "left")
    a = fd.finding(n, "WORD_ID_DUPLICATE_OR_EMPTY", (F.col("n") > 1) | (F.col("word_id") == ""), F.col("word_id"), work="source_id")
    b = fd.checks(
        w,
        [
            ("WORD_TEXT_REQUIRED", tx.strip("text") == ""), ("SPEAKER_REQUIRED", F.coalesce("speaker", F.lit("")) == ""),
            ("SOURCE_RANGE_INVALID", F.col("duration_us").isNull() | (F.col("start_us") < 0) | (F.col("end_us") <= F.col("start_us")) | (F.col("end_us") > F.col("duration_us") + tol_us)),
            ("WORDS_NOT_CHRONOLOGICAL", F.col("start_us") < F.col("__p")), ("CONFIDENCE_OUT_OF_RANGE", (F.col("confidence") < 0) | (F.col("confidence") > 1)),
        ],
        work="source_id", entity="word_id",
    )
    return a.unionByName(b)


def normalize_asr(words: DataFrame, segments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SRC7: recogniser rows; a source with any issue yields no words at all.

    ``words``: source_id, seg, pos, text, start_us, end_us, confidence.  ``segments``:
    source_id, seg, text.
    """
    bad_span = F.col("start_us").isNull() | F.col("end_us").isNull() | (F.col("start_us") < 0) | (F.col("end_us") <= F.col("start_us")) | F.col("confidence").isNull() | (F.col("confidence") < 0) | (F.col("confidence") > 1) | (tx.strip("text") == "")
    # only valid words move the clock forward
    w = words.withColumn("__v", ~F.coalesce(bad_span, F.lit(True)))
    w = scan(w, ["source_id"], ["seg", "pos"], by_rows("seg", 256), maxes={"__p": F.when(F.col("__v"), F.col("start_us"))})
    wrong = ~F.col("__v") | (F.col("start_us") < F.col("__p"))
    i1 = w.where(wrong).select("source_id", "seg", F.lit("INVALID_OR_ZERO_WORD_SPAN_PROBABILITY_OR_TEXT").alias("reason"))
    joined = words.groupBy("source_id", "seg").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "").alias("__j"))
    s = segments.join(joined, ["source_id", "seg"], "left")
    flat = lambda c: F.regexp_replace(c, tx.SPACE, "")
    i2 = s.where((tx.strip("text") != "") & F.col("__j").isNull()).select("source_id", "seg", F.lit("TEXT_WITHOUT_WORD_TIMES").alias("reason"))
    i3 = s.where(flat(F.coalesce("__j", F.lit(""))) != flat(F.col("text"))).select("source_id", "seg", F.lit("SEGMENT_WORD_TEXT_MISMATCH").alias("reason"))
    issues = i1.unionByName(i2).unionByName(i3)
    good = words.join(issues.select("source_id").distinct(), "source_id", "left_anti")
    return good.withColumn("word_id", F.format_string("w%05d-%04d", "seg", "pos")), issues


def apply_alignment(cues: DataFrame, words: DataFrame, tokens: DataFrame, bin_us: int = BIN_US) -> tuple[DataFrame, DataFrame]:
    """SRC8: aligned word times where every token of a cue was observed and the cue
    overlaps no other cue; all other cues keep their estimates with the reason.

    ``tokens``: source_id, cue_id, ord, text, status, start_us, end_us, score.
    """
    key = ["source_id", "cue_id"]
    other = cues.select("source_id", F.col("cue_id").alias("o_id"), F.col("start_us").alias("b_start_us"), F.col("end_us").alias("b_end_us"))
    c = cues.select(*key, "start_us", "end_us")
    lap = interval_join(c, other, ["source_id"], bin_us=bin_us, where=F.col("cue_id") != F.col("o_id")).select(*key).distinct().withColumn("lap", F.lit(True))
    t = tokens.groupBy(*key).agg(F.bool_and(F.col("status") == "observed").alias("seen"), F.count(F.lit(1)).alias("nt"))
    state = c.join(t, key, "inner").join(lap, key, "left")
    why = F.when(F.coalesce("lap", F.lit(False)), "overlapping_subtitle_cues").when(~F.col("seen") | (F.col("nt") == 0), "incomplete_or_inferred_tokens")
    state = state.select(*key, why.alias("reason"), F.when(why.isNull(), "aligned").otherwise("estimated").alias("status"))
    ok = state.where("status = 'aligned'").select(*key)
    new = tokens.join(ok, key).select(*key, F.col("ord").cast("bigint").alias("ord"), "start_us", "end_us", "text", F.lit("aligned").alias("timing"), "score")
    old = words.join(ok, key, "left_anti").select(*key, "ord", "start_us", "end_us", "text", "timing", F.lit(None).cast("double").alias("score"))
    return new.unionByName(old), state


def chars_to_tokens(chars: DataFrame, tokens: DataFrame) -> DataFrame:
    """SRC9: token times from timed characters; a token with an untimed character is
    missing.

    ``chars``: source_id, cue_id, pos, start_us, end_us, score (NULL = untimed).
    ``tokens``: source_id, cue_id, ord, text, c0, c1 (character range, half-open).
    """
    key = ["source_id", "cue_id"]
    t = tokens.withColumn("pos", F.explode(F.sequence(F.col("c0"), F.col("c1") - 1)))
    j = t.join(chars, [*key, "pos"], "left")
    g = j.groupBy(*key, "ord", "text").agg(
        F.bool_and(F.col("start_us").isNotNull() & F.col("score").isNotNull()).alias("ok"), F.min_by("start_us", "pos").alias("a"), F.max_by("end_us", "pos").alias("b"), F.avg("score").alias("s")
    )
    when = lambda c: F.when(F.col("ok"), F.col(c))
    return g.select(*key, "ord", "text", F.when(F.col("ok"), "observed").otherwise("missing").alias("status"), when("a").alias("start_us"), when("b").alias("end_us"), F.round(when("s"), 9).alias("score"))


# -- SRC10 ------------------------------------------------------------------------


def _signal_rows(lines: DataFrame, order: list[str], block, keys: list[str]) -> DataFrame:
    """Rows of lines (``path``, ``line``) in ``order``: an open row runs on across blocks of lines."""
    head = F.startswith("line", F.lit("frame:"))
    r = lines.where(head | F.contains("line", F.lit("="))).withColumn("__h", head.cast("bigint"))
    r = scan(r, ["path"], order, block, sums={"row": F.col("__h")}).where("row > 0")
    t = F.regexp_extract("line", r"pts_time:([^\s]+)", 1)
    k, v = F.substring_index("line", "=", 1), F.expr("substring(line, instr(line, '=') + 1)").try_cast("double")
    fin = F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)
    tails = [name.rsplit(".", 1)[-1] for name in keys]
    names = [t if tails.count(t) == 1 else name.replace(".", "_") for t, name in zip(tails, keys, strict=True)]
    last = F.struct(*order)
    return r.groupBy("path", "row").agg(
        F.max(F.when(F.col("__h") == 1, F.round(F.nullif(t, F.lit("")).try_cast("decimal(20,6)") * 1_000_000).cast("bigint"))).alias("t_us"),
        *[F.max_by(F.when(k == name, fin), F.when((F.col("__h") == 0) & (k == name), last)).alias(out) for name, out in zip(keys, names, strict=True)],
    )


def parse_signal_log(texts: DataFrame, keys: list[str]) -> DataFrame:
    """SRC10: measurement logs: a ``frame:`` line with ``pts_time`` opens a row, the
    ``key=value`` lines below fill it; values that are not finite are NULL.  A column is
    named by the last part of its key, or by the whole key where two end alike."""
    r = texts.select("path", F.posexplode(F.split(_unix(F.col("value")), "\n")).alias("n", "line"))
    return _signal_rows(r, ["n"], by_rows("n"), keys)


def read_signal_log(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """SRC10 from files of any size: Spark cuts them at lines, and the place of a cut and
    the order of reading behind it put the lines of a file in order again."""
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("n"), F.regexp_replace("value", "^\ufeff", "").alias("line"),
    )
    return _signal_rows(lines, ["at", "n"], by_rows("at", 1 << 26), keys)


def check_signal_log(rows: DataFrame) -> DataFrame:
    """SRC10 findings: missing time stamps and times that do not rise."""
    r = scan(rows, ["path"], ["row"], by_rows("row"), lags={"__p": F.col("t_us")})
    return fd.checks(r, [("MEASUREMENT_TIMESTAMP_MISSING", F.col("t_us").isNull()), ("MEASUREMENT_TIME_NOT_INCREASING", F.col("t_us") <= F.col("__p"))], work="path", entity="row")


# -- SRC11 ------------------------------------------------------------------------

TRACKS = (
    "struct<tracks:array<struct<track_id:string,kind:string,children:array<struct<schema:string,instance_id:string,resource_id:string,start_us:bigint,duration_us:bigint,enabled:boolean>>>>>"
)


def parse_interchange(texts: DataFrame, base: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """SRC11: track items with their target start, track ends, and findings.

    Gaps advance the track's cursor; unknown item kinds are reported and kept out.
    ``base``: instance_id, track_id known from the export.
    """
    d = texts.select("path", F.from_json("value", TRACKS).alias("d")).select("path", F.posexplode("d.tracks").alias("t", "k"))
    i = d.select("path", "k.track_id", F.posexplode("k.children").alias("p", "c")).select("path", "track_id", F.col("p").cast("bigint").alias("pos"), "c.*")
    known = F.col("schema").isin("Clip.1", "Clip.2", "Gap.1")
    clip = F.col("schema").isin("Clip.1", "Clip.2")
    move = F.when(known, F.coalesce("duration_us", F.lit(0))).otherwise(0)
    i = scan(i, ["path", "track_id"], ["pos"], by_rows("pos"), sums={"__end": move})
    i = i.withColumn("target_start_us", F.col("__end") - move)
    b = base.select("instance_id", F.col("track_id").alias("base_track"))
    dup = i.where(clip).groupBy("path", "instance_id").agg(F.count(F.lit(1)).alias("__n"))
    j = i.join(b, "instance_id", "left").join(dup, ["path", "instance_id"], "left")
    bad = fd.checks(
        j,
        [
            ("HOST_ITEM_SCHEMA_UNSUPPORTED", ~known), ("INSTANCE_ID_MISSING_UNKNOWN_OR_DUPLICATE", clip & (F.col("base_track").isNull() | (F.col("__n") > 1))),
            ("HOST_EMPTY_GAP", (F.col("schema") == "Gap.1") & (F.coalesce("duration_us", F.lit(0)) <= 0)), ("HOST_SOURCE_RANGE_INVALID", clip & ((F.col("start_us") < 0) | (F.col("duration_us") <= 0))),
            ("HOST_DISABLED_ITEM_UNSUPPORTED", ~F.coalesce("enabled", F.lit(True))),
        ],
        work="path", entity=F.concat_ws("/", "track_id", "pos"),
    )
    ends = i.groupBy("path", "track_id").agg(F.max("__end").alias("track_end_us"), F.max(F.when(clip, F.col("__end"))).alias("last_clip_us"))
    trail = fd.finding(ends, "HOST_TRAILING_GAP_REQUIRES_EXPLICIT_MAPPING", F.col("track_end_us") > F.coalesce("last_clip_us", F.lit(0)), F.col("track_id"), work="path")
    items = i.where(clip).select("path", "track_id", "pos", "instance_id", "resource_id", "start_us", "duration_us", "target_start_us")
    return items, ends, bad.unionByName(trail)


def read_interchange(spark: SparkSession, path: str, base: DataFrame):
    return parse_interchange(_texts(spark, path), base)


# -- SRC12 ------------------------------------------------------------------------


def pair_sidecars(videos: DataFrame, files: DataFrame) -> DataFrame:
    """SRC12: the subtitle of each video: exact stem in the best format, else the same
    stem with one language tag; two candidates are ambiguous.

    Both tables: folder, name.
    """
    def parts(t, p):
        stem = F.lower(F.regexp_replace("name", r"\.[^.]*$", ""))
        ext = F.lower(F.regexp_extract("name", r"(\.[^.]*)$", 1))
        return t.select("folder", F.col("name").alias(f"{p}_name"), stem.alias(f"{p}_stem"), ext.alias(f"{p}_ext"))

    v = parts(videos, "v")
    s = parts(files, "s").where(F.col("s_ext").isin(fixed.SIDECAR_FORMATS))
    exact = v.join(s, (v.folder == s.folder) & (v.v_stem == s.s_stem)).select(v.folder, "v_name", "s_name", "s_ext", F.lit(0).alias("rank"))
    # language tags have a bounded number of pieces: offer every stem without its tail
    cut = s.withColumn("at", F.explode(F.sequence(F.lit(1), F.length("s_stem"))))
    cut = cut.where(F.substring("s_stem", F.col("at"), F.lit(1)).isin(".", "_", "-", " ")).withColumn("v_stem", F.substring("s_stem", F.lit(1), F.col("at") - 1)).withColumn("tag", F.expr("substring(s_stem, at + 1)"))
    cut = cut.where(F.col("tag").rlike(fixed.SIDECAR_LANGUAGE))
    local = v.join(cut.select("folder", "v_stem", "s_name", "s_ext"), ["folder", "v_stem"]).select("folder", "v_name", "s_name", "s_ext", F.lit(1).alias("rank"))
    both = exact.unionByName(local)
    form = F.when(F.col("rank") == 0, F.array_position(F.array(*[F.lit(x) for x in fixed.SIDECAR_FORMATS]), F.col("s_ext"))).otherwise(0)
    best = both.withColumn("key", F.struct("rank", form.alias("f")))
    top = best.groupBy("folder", "v_name").agg(F.min("key").alias("key"))
    g = best.join(top, ["folder", "v_name", "key"]).groupBy("folder", "v_name").agg(F.count(F.lit(1)).alias("n"), F.min("s_name").alias("s"))
    out = parts(videos, "v").select("folder", "v_name").join(g, ["folder", "v_name"], "left")
    state = F.when(F.col("n").isNull(), "none").when(F.col("n") > 1, "ambiguous").otherwise("paired")
    return out.select("folder", F.col("v_name").alias("name"), F.when(F.col("n") == 1, F.col("s")).alias("sidecar"), state.alias("state"))
