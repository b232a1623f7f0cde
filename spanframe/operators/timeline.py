"""Timeline compilation: exact frames, placement, and the map from source to output time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanframe.functions.clock import US, frames_to_us, half_even, half_up, overlap_us, span_frames, wide
from spanframe.plans import findings as fd
from spanframe.plans.bins import BIN_US, interval_join
from spanframe.plans.ordered import by_rows, by_time, scan

AUDIO_RATE = 48_000


def frame_count(clips: DataFrame) -> DataFrame:
    """TL1: output frames of each clip, half-even."""
    return clips.withColumn("frames", span_frames("start_us", "end_us", "fps_num", "fps_den", "speed_num", "speed_den"))


def check_clips(clips: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """Plan rules per clip: speed and gain limits, frame rate, subframe clips, known source."""
    rows = frame_count(clips)
    rules = [
        ("FPS_OUT_OF_RANGE", (F.col("fps_num") < F.col("fps_den")) | (F.col("fps_num") > F.col("fps_den") * 120)),
        ("SPEED_OUT_OF_RANGE", (F.col("speed_num") * 2 < F.col("speed_den")) | (F.col("speed_num") > F.col("speed_den") * 2)),
        ("GAIN_OUT_OF_RANGE", (F.col("gain_db") < -120) | (F.col("gain_db") > 24)),
        ("SUBFRAME_CLIP", F.col("frames") <= 0),
    ]
    if sources is not None:
        rows = rows.join(sources.select("source_id", F.lit(True).alias("__known")), "source_id", "left")
        rules.append(("UNKNOWN_SOURCE", F.col("__known").isNull()))
    return fd.checks(rows, rules, entity="clip_id", source="source_id")


def place_clips(clips: DataFrame, counted: DataFrame | None = None) -> DataFrame:
    """TL2: running frame cursor, output times, effective source end, quantisation.

    ``counted``: a table with no fewer rows of any work that costs less to count.
    """
    c = scan(frame_count(clips), ["work_id"], ["ord"], by_rows("ord"), sums={"out_end_frame": F.col("frames")}, within=counted)
    c = c.withColumn("out_start_frame", F.col("out_end_frame") - F.col("frames"))
    used = half_even(wide("frames", US, "fps_den", "speed_num"), wide("fps_num", "speed_den"))
    wanted = half_even(wide(F.col("end_us") - F.col("start_us"), "speed_den"), "speed_num")
    return (
        c.withColumn("out_start_us", frames_to_us("out_start_frame", "fps_num", "fps_den"))
        .withColumn("out_end_us", frames_to_us("out_end_frame", "fps_num", "fps_den"))
        .withColumn("eff_source_end_us", F.least(F.col("end_us"), F.col("start_us") + used))
        .withColumn("quant_delta_us", frames_to_us("frames", "fps_num", "fps_den") - wanted)
    )


def segment_durations(segments: DataFrame, visuals: DataFrame) -> DataFrame:
    """Segments with ``dur_us``: the voice length if there is one, else the visual sum."""
    total = visuals.groupBy("work_id", "segment_id").agg(F.sum(F.col("end_us") - F.col("start_us")).alias("visual_us"), F.count(F.lit(1)).alias("n_visuals"))
    s = segments.join(total, ["work_id", "segment_id"], "left").na.fill(0, ["visual_us", "n_visuals"])
    voiced = (F.col("mode") == "voiceover") & (F.coalesce("voice_us", F.lit(0)) > 0)
    return s.withColumn("dur_us", F.when(voiced, F.col("voice_us")).otherwise(F.col("visual_us")))


def nominal_timeline(segments: DataFrame, visuals: DataFrame, counted: DataFrame | None = None) -> DataFrame:
    """TL3: nominal output start and end of each segment.

    ``counted``: segments that cost less to count.
    """
    s = scan(segment_durations(segments, visuals), ["work_id"], ["ord"], by_rows("ord"), sums={"out_end_us": F.col("dur_us")}, within=segments if counted is None else counted)
    return s.withColumn("out_start_us", F.col("out_end_us") - F.col("dur_us"))


def quantize(df: DataFrame, cols: list[str], rate_num: int, rate_den: int = 1, suffix: str = "_q") -> DataFrame:
    """TL4: half-up ticks of microsecond columns, and the residual in units of
    ``1 / (1e6 * rate_den)`` ticks."""
    for c in cols:
        n, d = wide(c, rate_num), wide(US, rate_den)
        q = half_up(n, d)
        df = df.withColumn(c + suffix, q).withColumn(c + suffix + "_rest", (n - wide(q, US, rate_den)).cast("bigint"))
    return df


def realized_timeline(segments: DataFrame, visuals: DataFrame, facts: DataFrame, fps_num: int, fps_den: int) -> tuple[DataFrame, DataFrame]:
    """TL5: the measured output clock and its findings.

    ``facts`` per segment: frame_count, sample_count, decoded_sample_count, padding,
    encoder_delay, fps_num, fps_den, sample_rate.  One frame of drift is tolerated
    per segment and in total.
    """
    f = facts.withColumnRenamed("fps_num", "__fn").withColumnRenamed("fps_den", "__fd")
    s = segment_durations(segments, visuals).join(f, ["work_id", "segment_id"], "left")
    frames = F.coalesce("frame_count", F.lit(0)).cast("bigint")
    s = scan(
        s, ["work_id"], ["ord"], by_rows("ord"), sums={"end_frame": frames, "nominal_end_us": F.col("dur_us")}, within=segments
    ).withColumn("start_frame", F.col("end_frame") - frames)
    for edge in ("start", "end"):
        n, d = wide(f"{edge}_frame", AUDIO_RATE, fps_den), wide(fps_num)
        s = s.withColumn(f"{edge}_sample", half_up(n, d))
    s = s.withColumn("sample_rest", (wide("end_frame", AUDIO_RATE, fps_den) - wide("end_sample", fps_num)).cast("bigint"))
    # lengths compared in units of 1 / (1e6 * fps_num) seconds; one frame = 1e6 * fps_den
    one = wide(US, fps_den)

    def drift(us_col, frame_col):
        return F.abs(wide(frame_col, US, fps_den) - wide(us_col, fps_num))

    audio = F.abs(wide("sample_count", fps_num) - wide("frame_count", AUDIO_RATE, fps_den))
    bad = fd.checks(
        s,
        [
            ("REALIZED_FRAME_COUNT_MISSING", F.coalesce("frame_count", F.lit(0)) <= 0),
            ("REALIZED_SAMPLE_COUNT_MISSING", F.coalesce("sample_count", F.lit(0)) <= 0),
            ("REALIZED_FPS_MISMATCH", F.col("__fn") * fps_den != F.col("__fd") * fps_num),
            ("REALIZED_SAMPLE_RATE_MISMATCH", F.col("sample_rate") != AUDIO_RATE),
            (
                "REALIZED_AUDIO_PADDING_INVALID",
                (F.col("decoded_sample_count") != F.col("sample_count") + F.col("padding"))
                | (F.col("padding") < 0) | (F.col("padding") > 8192) | (F.col("encoder_delay") < 0) | (F.col("encoder_delay") > 8192),
            ),
            ("REALIZED_AUDIO_VIDEO_DRIFT", audio > wide(AUDIO_RATE, fps_den)),
            ("REALIZED_DURATION_DRIFT", drift("dur_us", "frame_count") > one),
            ("REALIZED_CUMULATIVE_DRIFT", drift("nominal_end_us", "end_frame") > one),
        ],
        entity="segment_id",
    )
    clock = s.select("work_id", "ord", "segment_id", "start_frame", "end_frame", "start_sample", "end_sample", "sample_rest", "nominal_end_us")
    return clock, bad


def map_cues(cues: DataFrame, timeline: DataFrame, policy: str = "clip", bin_us: int = BIN_US) -> tuple[DataFrame, DataFrame]:
    """TL6: source cues on the output clock, and findings.

    ``clip`` cuts cues at clip bounds and flags them partial; ``reject-partial``
    leaves them out and reports them.  One cue may map through several clips.
    """
    if policy not in ("clip", "reject-partial"):
        raise ValueError("policy must be clip or reject-partial")
    t = timeline.select(
        "work_id", "clip_id", "source_id", F.col("start_us").alias("clip_start_us"), F.col("eff_source_end_us").alias("clip_end_us"),
        "speed_num", "speed_den", "out_start_us", "out_end_us",
    )
    c = cues.select("source_id", "cue_id", "text", "start_us", "end_us")
    p = interval_join(t, c, ["source_id"], a_span=("clip_start_us", "clip_end_us"), b_span=("start_us", "end_us"), bin_us=bin_us)
    left, right = F.greatest("start_us", "clip_start_us"), F.least("end_us", "clip_end_us")
    p = p.withColumn("partial", (left > F.col("start_us")) | (right < F.col("end_us")))

    def at(x):
        return F.col("out_start_us") + half_even(wide(x - F.col("clip_start_us"), "speed_den"), "speed_num")

    p = p.withColumn("map_start_us", at(left)).withColumn("map_end_us", F.least(F.col("out_end_us"), at(right)))
    lost = F.col("map_start_us") >= F.col("map_end_us")
    rules = [("CUE_LOST_TO_FRAME_QUANTIZATION", lost)]
    keep = ~lost
    if policy == "reject-partial":
        rules.append(("PARTIAL_CUE", F.col("partial")))
        keep = keep & ~F.col("partial")
    bad = fd.checks(p, rules, entity="cue_id", source="source_id", evidence=F.col("clip_id"))
    out = p.where(keep).select(
        "work_id", "clip_id", "cue_id", F.col("map_start_us").alias("start_us"), F.col("map_end_us").alias("end_us"), "text", "partial"
    )
    return out, bad


def consume_visuals(segments: DataFrame, visuals: DataFrame, counted: DataFrame | None = None) -> DataFrame:
    """TL7: the part of each visual that is really played.

    Original segments play everything; voiced segments spend their voice (or planned)
    length over the visuals in order.  Adds ``local_us``, the offset in the segment.
    ``counted``: visuals that cost less to count.
    """
    v = scan(
        visuals, ["work_id", "segment_id"], ["ord"], by_rows("ord"), sums={"__upto": F.col("end_us") - F.col("start_us")}, within=counted
    )
    s = segments.select("work_id", "segment_id", "mode", F.coalesce(F.when(F.col("voice_us") > 0, F.col("voice_us")), F.col("planned_us")).alias("__budget"))
    v = v.join(s, ["work_id", "segment_id"])
    length = F.col("end_us") - F.col("start_us")
    prior = F.col("__upto") - length
    used = F.when(F.col("mode") == "original", length).otherwise(F.least(length, F.col("__budget") - prior))
    v = v.withColumn("used_us", used).withColumn("local_us", prior).where("used_us > 0")
    return v.withColumn("end_us", F.col("start_us") + F.col("used_us")).drop("__upto", "__budget")


def build_edl(segments: DataFrame, visuals: DataFrame, realized: DataFrame | None = None, fps_num: int = 30, fps_den: int = 1) -> DataFrame:
    """TL8: one row per played visual with its output range.

    With a realised clock (``start_frame``/``end_frame`` per segment) the inner cuts
    are put on its frames and the last visual ends with the segment.
    """
    played = consume_visuals(segments, visuals)
    if realized is None:
        clock = nominal_timeline(segments, visuals).select("work_id", "segment_id", F.col("ord").alias("seg_ord"), F.col("out_start_us").alias("__at"))
        e = played.join(clock, ["work_id", "segment_id"])
        out = F.col("__at") + F.col("local_us")
        return e.select(
            "work_id", "seg_ord", "segment_id", "ord", "source_id", "start_us", "end_us", out.alias("out_start_us"), (out + F.col("used_us")).alias("out_end_us"), "unit_id"
        )
    clock = realized.select("work_id", "segment_id", F.col("ord").alias("seg_ord"), "start_frame", "end_frame")
    last = played.groupBy("work_id", "segment_id").agg(F.max("ord").alias("__last"))
    e = played.join(clock, ["work_id", "segment_id"]).join(last, ["work_id", "segment_id"])

    def frame(us):
        return F.col("start_frame") + half_up(wide(us, fps_num), wide(US, fps_den))

    end = F.when(F.col("ord") == F.col("__last"), F.col("end_frame")).otherwise(frame(F.col("local_us") + F.col("used_us")))
    begin = frame("local_us")
    return e.select(
        "work_id", "seg_ord", "segment_id", "ord", "source_id", "start_us", "end_us", begin.alias("out_start_frame"), end.alias("out_end_frame"),
        ((end <= begin) | (end > F.col("end_frame"))).alias("out_of_range"),
    )


def first_use(segments: DataFrame, visuals: DataFrame, highlights: DataFrame, bin_us: int = BIN_US, counted: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """TL9: first offset at which a segment really plays a highlight's source range.

    ``counted``: visuals and highlights that cost less to measure.
    """
    played = consume_visuals(segments, visuals, counted=counted[0] if counted else None).select("work_id", "segment_id", "source_id", "start_us", "end_us", "local_us")
    h = lambda t: t.select("work_id", "highlight_id", "source_id", F.col("start_us").alias("b_start_us"), F.col("end_us").alias("b_end_us"))
    # a played range is no longer than its visual
    p = interval_join(played, h(highlights), ["work_id", "source_id"], bin_us=bin_us, counted=(counted[0], h(counted[1])) if counted else None)
    at = F.col("local_us") + F.greatest("start_us", "b_start_us") - F.col("start_us")
    return p.groupBy("work_id", "segment_id", "highlight_id").agg(F.min(at).alias("offset_us"))


def place_anchored(items: DataFrame, timeline: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    """TL10: captions, tracks or layers at ``anchor clip start + offset``.

    ``items``: work_id, item_id, anchor_clip_id (NULL = work start), offset_us, len_us.
    """
    anchor = timeline.select("work_id", F.col("clip_id").alias("anchor_clip_id"), F.col("out_start_us").alias("__at"))
    total = timeline.groupBy("work_id").agg(F.max("out_end_us").alias("work_us"))
    p = items.join(anchor, ["work_id", "anchor_clip_id"], "left").join(total, "work_id", "left")
    start = F.when(F.col("anchor_clip_id").isNull(), F.lit(0)).otherwise(F.col("__at")) + F.col("offset_us")
    p = p.withColumn("out_start_us", start).withColumn("out_end_us", start + F.col("len_us"))
    name = kind.upper()
    bad = fd.checks(
        p,
        [
            (f"{name}_ANCHOR_MISSING", F.col("anchor_clip_id").isNotNull() & F.col("__at").isNull()),
            (f"{name}_OUTSIDE_WORK", (F.col("out_start_us") < 0) | (F.col("out_end_us") > F.col("work_us"))),
        ],
        entity="item_id",
    )
    return p.drop("__at"), bad


def fit_voice(segments: DataFrame, min_permille: int = 950, max_permille: int = 1080) -> DataFrame:
    """TL29: stretch a voice to the wanted length when the speed stays in bounds.

    ``raw_us`` is the recorded length, ``planned_us`` the wanted one; ``words`` (array of
    start_us, dur_us) is scaled by the same factor.  Speed is ``speed_num/speed_den``.
    """
    raw, want = F.col("raw_us"), F.col("planned_us")
    ok = (raw > 0) & (want > 0) & (raw * 1000 >= want * min_permille) & (raw * 1000 <= want * max_permille)
    out = segments.withColumn("fitted", F.coalesce(ok, F.lit(False)))
    num = F.when(F.col("fitted"), raw).otherwise(F.lit(1).cast("bigint"))
    den = F.when(F.col("fitted"), want).otherwise(F.lit(1).cast("bigint"))
    out = out.withColumn("speed_num", num).withColumn("speed_den", den).withColumn("audio_us", F.when(F.col("fitted"), want).otherwise(raw))
    if "words" in segments.columns:
        moved = F.transform(
            "words",
            lambda w: F.struct(
                half_even(wide(w["start_us"], F.col("speed_den")), F.col("speed_num")).alias("start_us"),
                half_even(wide(w["dur_us"], F.col("speed_den")), F.col("speed_num")).alias("dur_us"),
            ),
        )
        out = out.withColumn("words", moved)
    return out


def fade_samples(items: DataFrame, rate: int = AUDIO_RATE) -> DataFrame:
    """TL30: length and fades in samples, the rounding left over, and the broken rule."""
    length = F.col("end_us") - F.col("start_us")
    n = half_even(wide(length, rate), US)
    fi, fo = half_even(wide("fade_in_us", rate), US), half_even(wide("fade_out_us", rate), US)
    reason = (
        F.when(F.col("fade_in_us") + F.col("fade_out_us") > length, "FADES_EXCEED_INTERVAL")
        .when((n <= 0) | (fi + fo > n), "SAMPLE_QUANTIZATION_INVALID")
        .when(((F.col("fade_in_us") > 0) & (fi == 0)) | ((F.col("fade_out_us") > 0) & (fo == 0)), "SUBSAMPLE_FADE")
        .otherwise("")
    )
    return items.select(
        "*", n.alias("samples"), fi.alias("fade_in_samples"), fo.alias("fade_out_samples"),
        (wide(n, US) - wide(length, rate)).cast("bigint").alias("rest"), reason.alias("reason"),
    )


def declare_offset(rows: DataFrame) -> DataFrame:
    """TL33: session offset from two declared clock origins; coverage must fit both media."""
    off = F.col("follower_origin_us") - F.col("reference_origin_us")
    lo, hi = F.col("cover_start_us"), F.col("cover_end_us")
    ok = (lo < hi) & (lo >= 0) & (hi <= F.col("reference_us")) & (lo - off >= 0) & (hi - off <= F.col("follower_us"))
    return rows.withColumn("offset_us", off).withColumn("state", F.when(ok, "DECLARED").otherwise("CLOCK_COVERAGE_INVALID"))


def gain_windows(windows: DataFrame, works: DataFrame) -> tuple[DataFrame, DataFrame]:
    """TL34: gain windows relative to the base gain, and their order and range findings."""
    w = windows.join(works.select("work_id", "duration_us", "base_gain_db"), "work_id")
    w = scan(w, ["work_id"], ["start_us", "window_id"], by_time("start_us"), maxes={"__reach": F.col("end_us")})
    bad = fd.checks(
        w,
        [
            ("OVERLAPPING_GAIN_WINDOWS", F.col("start_us") < F.col("__reach")),
            ("SOURCE_RANGE_INVALID", (F.col("start_us") < 0) | (F.col("end_us") <= F.col("start_us")) | (F.col("end_us") > F.col("duration_us") + 1)),
            ("GAIN_OUT_OF_RANGE", (F.col("gain_db") < -120) | (F.col("gain_db") > 24)),
        ],
        entity="window_id",
    )
    return w.withColumn("relative_db", F.col("gain_db") - F.col("base_gain_db")).drop("__reach"), bad


def place_tracks(tracks: DataFrame, works: DataFrame, rate: int = AUDIO_RATE) -> DataFrame:
    """TL34: output sample of each audio track and whether it runs past the picture."""
    t = tracks.join(works.select("work_id", "duration_us"), "work_id")
    return t.withColumn("out_start_sample", half_even(wide("out_start_us", rate), US)).withColumn(
        "exceeds_picture", F.col("out_start_us") + F.col("end_us") - F.col("start_us") > F.col("duration_us") + 1
    )


def check_burn_list(cues: DataFrame, keys: list[str]) -> DataFrame:
    """TL35: burn list order, shortest display of one centisecond, no control characters."""
    c = scan(cues, keys, ["ord"], by_rows("ord"), lags={"__prev": F.col("end_us")})
    return fd.checks(
        c,
        [
            ("OVERLAPPING_CAPTIONS", F.col("start_us") < F.coalesce("__prev", F.lit(0))),
            ("CUE_TOO_SHORT", half_even("end_us", F.lit(10_000)) <= half_even("start_us", F.lit(10_000))),
            ("CUE_TEXT_REQUIRED", F.trim("text") == ""),
            ("CONTROL_CHARACTERS_UNSUPPORTED", F.col("text").rlike(r"[{}\\\r]")),
        ],
        work=keys[0], entity="cue_id",
    )


def attach_cues(segments: DataFrame, visuals: DataFrame, cues: DataFrame, known: DataFrame, bin_us: int = BIN_US) -> tuple[DataFrame, DataFrame]:
    """TL32: transcript cues under each original segment, and whether they are verified.

    A segment is verified when it has visuals and every visual's source is in
    ``known(source_id, current)`` with an equal hash.
    """
    orig = segments.where("mode = 'original'").select("work_id", "segment_id")
    v = visuals.join(orig, ["work_id", "segment_id"]).select("work_id", "segment_id", "source_id", "start_us", "end_us")
    c = cues.select("source_id", "cue_id", F.col("start_us").alias("b_start_us"), F.col("end_us").alias("b_end_us"))
    hits = interval_join(v, c, ["source_id"], bin_us=bin_us).select("work_id", "segment_id", "source_id", "cue_id").distinct()
    ok = v.join(known.select("source_id", F.col("current").alias("__ok")), "source_id", "left")
    ok = ok.groupBy("work_id", "segment_id").agg(F.bool_and(F.coalesce("__ok", F.lit(False))).alias("v"))
    state = orig.join(ok, ["work_id", "segment_id"], "left").select("work_id", "segment_id", F.coalesce("v", F.lit(False)).alias("cues_verified"))
    return hits, state


def cut_projection(segments: DataFrame, visuals: DataFrame, facts: DataFrame, fps_num: int, fps_den: int) -> tuple[DataFrame, DataFrame]:
    """TL31: video, original-sound and narration items, and clock-alignment findings.

    ``facts(source_id, sample_rate, has_audio)``.  Every time must lie exactly on the
    frame grid (video) or sample grid (audio); nothing is rounded.
    """
    edl = build_edl(segments, visuals)
    mode = segments.select("work_id", "segment_id", "mode", "voice_us")
    e = edl.join(mode, ["work_id", "segment_id"]).join(facts.select("source_id", "sample_rate", "has_audio"), "source_id", "left")
    base = ["work_id", "segment_id", "seg_ord", "ord", "source_id", "start_us", "out_start_us"]
    length = (F.col("end_us") - F.col("start_us")).alias("len_us")
    video = e.select(F.lit("video").alias("track"), *base, length, F.lit(None).cast("bigint").alias("rate"))
    sound = e.where("mode = 'original' and has_audio").select(F.lit("original").alias("track"), *base, length, F.col("sample_rate").cast("bigint").alias("rate"))
    voice = (
        nominal_timeline(segments, visuals).where("mode = 'voiceover' and voice_us > 0")
        .select(
            F.lit("narration").alias("track"), "work_id", "segment_id", F.col("ord").alias("seg_ord"), F.lit(0).cast("bigint").alias("ord"),
            F.concat(F.lit("narration:"), F.col("segment_id")).alias("source_id"), F.lit(0).cast("bigint").alias("start_us"), "out_start_us",
            F.col("voice_us").alias("len_us"), F.lit(AUDIO_RATE).cast("bigint").alias("rate"),
        )
    )
    items = fd.union([video, sound, voice])

    def off_frame(c):
        return F.pmod(wide(c, fps_num), wide(US, fps_den)) != 0

    def off_sample(c):
        return F.pmod(wide(c, "rate"), wide(US)) != 0

    is_video, is_audio = F.col("track") == "video", F.col("track") != "video"
    bad = fd.checks(
        items,
        [
            ("UNALIGNED_OUTPUT_FRAME", is_video & off_frame("out_start_us")),
            ("UNALIGNED_SOURCE_FRAME", is_video & (off_frame("start_us") | off_frame("len_us"))),
            ("UNKNOWN_OR_UNSUPPORTED_AUDIO_CLOCK", is_audio & (F.coalesce("rate", F.lit(0)) <= 0)),
            ("UNALIGNED_AUDIO_SAMPLE", is_audio & (F.col("rate") > 0) & (off_sample("start_us") | off_sample("len_us") | off_sample("out_start_us"))),
        ],
        entity=F.concat_ws("/", "track", "segment_id", "ord"), source="source_id",
    )
    return items, bad
