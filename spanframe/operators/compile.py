"""Compiled plans: layers, multicamera, speech cuts, steps, evidence, events, localisation.

Each compiler returns rows and findings instead of stopping at the first violation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanframe.functions import text as tx
from spanframe.functions.clock import US, floor_div, half_even, wide
from spanframe.operators import intervals as iv
from spanframe.plans import findings as fd
from spanframe.plans.bins import BIN_US, interval_join
from spanframe.plans.ordered import by_rows, by_time, scan

OCC = ["work_id", "occurrence_id"]


def normalize_layers(layers: DataFrame, timeline: DataFrame, canvas: DataFrame) -> tuple[DataFrame, DataFrame]:
    """TL11: layers on output frames, and rule findings; draw order is ``z``.

    ``layers``: work_id, layer_id, anchor_clip_id, offset_frames, frames,
    source_start_frame, source_frames, source_width, source_height, x, y, w, h,
    opacity, z, allow_upscale.  ``canvas``: work_id, width, height.
    """
    at = timeline.select("work_id", F.col("clip_id").alias("anchor_clip_id"), F.col("out_start_frame").alias("__at"))
    total = timeline.groupBy("work_id").agg(F.max("out_end_frame").alias("__total"))
    j = layers.join(at, ["work_id", "anchor_clip_id"], "left").join(total, "work_id", "left").join(canvas.select("work_id", F.col("width").alias("__cw"), F.col("height").alias("__ch")), "work_id")
    same = layers.groupBy("work_id", "z").agg(F.count(F.lit(1)).alias("__nz"))
    j = j.join(same, ["work_id", "z"])
    start = F.when(F.col("anchor_clip_id").isNull(), F.lit(0)).otherwise(F.col("__at")) + F.col("offset_frames")
    j = j.withColumn("start_frame", start).withColumn("end_frame", start + F.col("frames"))
    x, y, w, h = (F.col(c) for c in "xywh")
    even = (x % 2 == 0) & (y % 2 == 0) & (w % 2 == 0) & (h % 2 == 0)
    bad = fd.checks(
        j,
        [
            ("OVERLAY_ANCHOR_MISSING", F.col("anchor_clip_id").isNotNull() & F.col("__at").isNull()),
            ("OVERLAY_OUTSIDE_BASE", (F.col("start_frame") < 0) | (F.col("frames") <= 0) | (F.col("end_frame") > F.col("__total"))),
            ("OVERLAY_SOURCE_FRAME_NEGATIVE", F.col("source_start_frame") < 0), ("OVERLAY_Z_AMBIGUOUS", F.col("__nz") > 1),
            ("OVERLAY_OPACITY_INVALID", (F.col("opacity") < 0) | (F.col("opacity") > 1)), ("OVERLAY_EVEN_RECT_REQUIRED", ~even),
            ("OVERLAY_RECT_OUTSIDE_CANVAS", (x < 0) | (y < 0) | (w < 2) | (h < 2) | (x + w > F.col("__cw")) | (y + h > F.col("__ch"))),
            ("OVERLAY_SOURCE_TOO_SHORT_NO_FREEZE", F.col("source_start_frame") + F.col("frames") > F.col("source_frames")),
            ("OVERLAY_ASPECT_DISTORTION", F.col("source_width") * h != F.col("source_height") * w),
            ("OVERLAY_UPSCALE_NOT_ALLOWED", ~F.col("allow_upscale") & ((w > F.col("source_width")) | (h > F.col("source_height")))),
        ],
        entity="layer_id",
    )
    return j.select("work_id", "layer_id", "z", "start_frame", "end_frame", "opacity", "x", "y", "w", "h"), bad


def check_rects(rects: DataFrame) -> DataFrame:
    """TL12: crop and placement geometry.

    ``rects``: work_id, rect_id, src_w, src_h, canvas_w, canvas_h, crop_x/y/w/h,
    place_x/y/w/h, allow_upscale.
    """
    c = {k: F.col(f"crop_{k}") for k in "xywh"}
    p = {k: F.col(f"place_{k}") for k in "xywh"}

    def odd(r):
        return (r["x"] % 2 != 0) | (r["y"] % 2 != 0) | (r["w"] % 2 != 0) | (r["h"] % 2 != 0)

    def small(r):
        return (r["x"] < 0) | (r["y"] < 0) | (r["w"] < 2) | (r["h"] < 2)

    return fd.checks(
        rects,
        [
            ("EVEN_RECT_REQUIRED", odd(c) | odd(p)), ("RECT_INVALID", small(c) | small(p)),
            ("CROP_OUTSIDE_SOURCE", (c["x"] + c["w"] > F.col("src_w")) | (c["y"] + c["h"] > F.col("src_h"))),
            ("PLACEMENT_OUTSIDE_CANVAS", (p["x"] + p["w"] > F.col("canvas_w")) | (p["y"] + p["h"] > F.col("canvas_h"))),
            ("ASPECT_DISTORTION", c["w"] * p["h"] != c["h"] * p["w"]),
            ("UPSCALE_NOT_ALLOWED", ~F.col("allow_upscale") & ((p["w"] > c["w"]) | (p["h"] > c["h"]))),
        ],
        entity="rect_id",
    )


def compile_multicam(sections: DataFrame, shots: DataFrame, placements: DataFrame, program: DataFrame, fps_num: int, fps_den: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """TL13: picture clips, program tracks and findings of session sections.

    Cut frames are quantised once on the section clock.  ``sections``: work_id,
    section_id, ord, start_us, end_us.  ``shots``: work_id, section_id, ord, angle_id,
    start_us, end_us.  ``placements``: source_id, offset_us, duration_us.
    ``program``: work_id, section_id, source_id, gain_db.
    """
    key = ["work_id", "section_id"]
    s = sections.select(*key, F.col("ord").alias("sec_ord"), F.col("start_us").alias("a"), F.col("end_us").alias("b"))
    s = s.withColumn("frames", floor_div(wide(F.col("b") - F.col("a"), fps_num), wide(US, fps_den)))
    j = scan(shots, key, ["ord"], by_rows("ord"), lags={"__pe": F.col("end_us")}, leads={"__ns": F.col("start_us")}).join(s, key)
    last = F.col("__ns").isNull()
    cut = F.when(last, F.col("frames")).otherwise(half_even(wide(F.col("end_us") - F.col("a"), fps_num), wide(US, fps_den)))
    j = j.withColumn("end_frame", cut)
    j = scan(j, key, ["ord"], by_rows("ord"), lags={"__pf": F.col("end_frame")}, within=shots).withColumn("start_frame", F.coalesce("__pf", F.lit(0)))

    def session(f):
        return F.col("a") + half_even(wide(f, US, fps_den), F.lit(fps_num))

    pl = placements.select(F.col("source_id").alias("angle_id"), F.col("offset_us").alias("__off"), F.col("duration_us").alias("__dur"))
    j = j.join(pl, "angle_id", "left").withColumn("source_start_us", session(F.col("start_frame")) - F.col("__off")).withColumn("source_end_us", session(F.col("end_frame")) - F.col("__off"))
    bad = fd.checks(
        j,
        [
            ("ANGLE_UNKNOWN", F.col("__off").isNull()),
            ("SHOT_GAP_OR_OVERLAP", (F.col("start_us") != F.coalesce("__pe", F.col("a"))) | (F.col("end_us") <= F.col("start_us")) | (F.col("end_us") > F.col("b"))),
            ("PICTURE_DOES_NOT_COVER_SEGMENT", last & (F.col("end_us") != F.col("b"))),
            ("SUBFRAME_OR_OVERRUN_SHOT", (F.col("end_frame") <= F.col("start_frame")) | (F.col("end_frame") > F.col("frames"))),
            ("SOURCE_RANGE_INVALID", (F.col("source_start_us") < 0) | (F.col("source_end_us") > F.col("__dur") + 1)),
        ],
        entity=F.concat_ws("/", "section_id", "ord"), source="angle_id",
    )
    bad = bad.unionByName(fd.finding(s, "SUBFRAME_SEGMENT", F.col("frames") <= 0, F.col("section_id")))
    clips = j.select(*key, "sec_ord", "ord", "angle_id", "start_frame", "end_frame", "source_start_us", "source_end_us")
    t = program.join(s, key).join(placements.select("source_id", F.col("offset_us").alias("__off")), "source_id")
    length = half_even(wide("frames", US, fps_den), F.lit(fps_num))
    tracks = t.select(*key, "source_id", "gain_db", (F.col("a") - F.col("__off")).alias("start_us"), (F.col("a") - F.col("__off") + length).alias("end_us"))
    return clips, tracks, bad


def check_sections(sections: DataFrame, allow_reorder: bool, allow_reuse: bool) -> DataFrame:
    """TL14: session order and reuse policy."""
    parts = []
    if not allow_reorder:
        s = scan(sections, ["work_id"], ["ord"], by_rows("ord"), lags={"__p": F.col("end_us")})
        parts.append(fd.finding(s, "SESSION_REORDER_NOT_AUTHORIZED", F.col("start_us") < F.col("__p"), F.col("section_id")))
    if not allow_reuse:
        r = iv.find_reuse(sections, ["work_id"]).join(sections.select("work_id", "ord", "section_id"), ["work_id", "ord"])
        parts.append(fd.finding(r, "SESSION_REUSE_NOT_AUTHORIZED", F.lit(True), F.col("section_id")))
    return fd.union(parts) if parts else fd.finding(sections, "", F.lit(False), F.col("section_id"))


def check_offsets(placements: DataFrame, measurements: DataFrame, uses: DataFrame, allow_declared: bool = True) -> DataFrame:
    """TL15: each placed source needs consistent evidence equal to its offset, and uses
    of declared clocks must lie in the declared coverage.

    ``placements``: source_id, offset_us, is_reference.  ``measurements``: source_id,
    method, state, offset_us, cover_start_us, cover_end_us.  ``uses``: source_id,
    use_id, session_start_us, session_end_us.
    """
    m = measurements.select("source_id", "method", "state", F.col("offset_us").alias("m_off"), F.col("cover_start_us").alias("c0"), F.col("cover_end_us").alias("c1"))
    j = placements.join(m, "source_id", "left")
    ref, declared = F.col("is_reference"), F.col("method") == "declared-clock"
    a = fd.checks(
        j,
        [
            ("REFERENCE_OFFSET_MUST_BE_ZERO", ref & ((F.col("offset_us") != 0) | F.col("method").isNotNull())),
            ("SYNC_EVIDENCE_MISSING", ~ref & F.col("method").isNull()),
            ("DECLARED_CLOCK_NOT_ALLOWED", ~ref & declared & F.lit(not allow_declared)),
            ("SYNC_MEASUREMENT_NOT_CONSISTENT", ~ref & ~declared & (F.col("state") != "CONSISTENT")),
            ("CLOCK_DECLARATION_INVALID", ~ref & declared & (F.col("state") != "DECLARED")),
            ("SYNC_OFFSET_EVIDENCE_MISMATCH", ~ref & ~F.col("m_off").eqNullSafe(F.col("offset_us")) & F.col("method").isNotNull()),
        ],
        work="source_id", entity="source_id",
    )
    u = uses.join(m.where("method = 'declared-clock'"), "source_id")
    out = (F.col("session_start_us") < F.col("c0")) | (F.col("session_end_us") > F.col("c1"))
    return a.unionByName(fd.finding(u, "OUTSIDE_DECLARED_CLOCK_COVERAGE", out, F.col("use_id"), work="source_id"))


def compile_speech(words: DataFrame, segments: DataFrame, picks: DataFrame, protected: DataFrame, allow_reorder: bool = False, bin_us: int = BIN_US) -> DataFrame:
    """TL16: findings of a word-level edit.

    ``words``: source_id, word_id, ord, start_us, end_us.  ``segments``: source_id,
    segment_id, ord, start_us, end_us, covered_end_us (end after frame rounding).
    ``picks``: source_id, segment_id, pos, word_id.  ``protected``: source_id, word_id.
    """
    key = ["source_id", "segment_id"]
    w = words.select("source_id", "word_id", F.col("ord").alias("w_ord"), F.col("start_us").alias("w0"), F.col("end_us").alias("w1"))
    p = picks.join(w, ["source_id", "word_id"], "left")
    s = segments.select(*key, F.col("ord").alias("seg_ord"), F.col("start_us").alias("s0"), F.col("end_us").alias("s1"), "covered_end_us")
    twice = picks.groupBy("source_id", "word_id").agg(F.count(F.lit(1)).alias("n"))
    common = {"work": "source_id"}
    a = fd.finding(twice, "DUPLICATE_WORD_USE", F.col("n") > 1, F.col("word_id"), **common)
    b = fd.finding(p, "WORD_UNKNOWN", F.col("w_ord").isNull(), F.col("word_id"), **common)
    g = p.groupBy(*key).agg(
        F.min("w_ord").alias("lo"), F.max("w_ord").alias("hi"), F.count("w_ord").alias("n"), F.min("pos").alias("p_lo"), F.bool_and(F.col("w_ord") - F.col("pos") >= 0).alias("__x"),
        F.count_distinct(F.col("w_ord") - F.col("pos")).alias("steps"), F.max("w1").alias("last_end"),
    ).join(s, key)
    c = fd.finding(g, "SEGMENT_WORDS_NOT_CONTIGUOUS", (F.col("hi") - F.col("lo") + 1 != F.col("n")) | (F.col("steps") > 1), F.col("segment_id"), **common)
    parts = [a, b, c]
    if not allow_reorder:
        o = scan(g, ["source_id"], ["seg_ord"], by_rows("seg_ord"), lags={"__h": F.col("hi")})
        parts.append(fd.finding(o, "REORDER_NOT_AUTHORIZED", F.col("lo") <= F.col("__h"), F.col("segment_id"), **common))
    q = p.join(s, key)
    parts.append(fd.finding(q, "KEPT_WORD_TRUNCATED", (F.col("s0") > F.col("w0")) | (F.col("s1") < F.col("w1")), F.col("word_id"), **common))
    near = interval_join(s.select(*key, "s0", "s1"), w.select("source_id", "word_id", "w0", "w1"), ["source_id"], a_span=("s0", "s1"), b_span=("w0", "w1"), bin_us=bin_us)
    extra = near.join(picks.select(*key, "word_id"), [*key, "word_id"], "left_anti")
    parts.append(fd.finding(extra, "UNLISTED_WORD_IN_AUDIO", F.lit(True), F.concat_ws("/", "segment_id", "word_id"), **common))
    gone = protected.join(picks.select("source_id", "word_id"), ["source_id", "word_id"], "left_anti")
    parts.append(fd.finding(gone, "PROTECTED_WORD_DELETED", F.lit(True), F.col("word_id"), **common))
    parts.append(fd.finding(g, "WORD_TRUNCATED_BY_FRAME_QUANTIZATION", F.col("covered_end_us") < F.col("last_end"), F.col("segment_id"), **common))
    return fd.union(parts)


def speech_decisions(words: DataFrame, picks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """TL17: text of each segment, and every word with its keep/remove decision."""
    p = picks.join(words.select("source_id", "word_id", "text"), ["source_id", "word_id"])
    t = p.groupBy("source_id", "segment_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), " ").alias("text"), F.count(F.lit(1)).alias("n_words"))
    kept = picks.select("source_id", "word_id").distinct().withColumn("__k", F.lit(True))
    return t, words.join(kept, ["source_id", "word_id"], "left").select("source_id", "word_id", F.coalesce("__k", F.lit(False)).alias("kept"))


ROLES = ["before", "action", "result"]


def step_map(steps: DataFrame, roles: DataFrame, requires: DataFrame, cues: DataFrame, timeline: DataFrame) -> tuple[DataFrame, DataFrame]:
    """TL18: tutorial steps on the output clock, and findings.

    ``steps``: work_id, step_id, context_id.  ``roles``: work_id, step_id, role, clip_id,
    start_us, end_us, hold_us.  ``requires``: work_id, step_id, dep_id.
    ``cues``: work_id, cue_id, step_id, start_us, end_us (output time).
    """
    key = ["work_id", "step_id"]
    t = timeline.select("work_id", "clip_id", "source_id", F.col("start_us").alias("c0"), F.col("eff_source_end_us").alias("c1"), "speed_num", "speed_den", "out_start_us", "out_end_us")
    r = roles.join(t, ["work_id", "clip_id"], "left").withColumn("r", F.array_position(F.array(*[F.lit(x) for x in ROLES]), F.col("role")))

    def at(c):
        return F.col("out_start_us") + half_even(wide(F.col(c) - F.col("c0"), "speed_den"), "speed_num")

    r = r.withColumn("o0", at("start_us")).withColumn("o1", at("end_us"))
    # one row per step: three roles at most
    flat = r.groupBy(*key).agg(
        F.count_distinct("source_id").alias("n_src"),
        *[F.max(F.when(F.col("role") == x, F.col(c))).alias(f"{x}_{n}") for x in ROLES for c, n in (("start_us", "s0"), ("end_us", "s1"), ("o0", "o0"), ("o1", "o1"))],
    )
    vis = (F.col("start_us") < F.col("c0")) | (F.col("end_us") > F.col("c1")) | (F.col("o1") > F.col("out_end_us"))
    bad = fd.checks(
        r,
        [
            ("EVENT_CLIP_UNKNOWN", F.col("c0").isNull()), ("EVENT_NOT_FULLY_VISIBLE", vis),
            ("READING_WINDOW_TOO_SHORT", (F.col("hold_us") <= 0) | (F.col("o1") - F.col("o0") < F.col("hold_us"))),
        ],
        entity=F.concat_ws("/", "step_id", "role"),
    )
    late = F.lit(False)
    for a, b in zip(ROLES, ROLES[1:]):
        late = late | (F.col(f"{b}_s0") < F.col(f"{a}_s1")) | (F.col(f"{b}_o0") < F.col(f"{a}_o1"))
    m = steps.join(flat, key)
    bad2 = fd.checks(m, [("STEP_MUST_USE_ONE_CAPTURE_SOURCE", F.col("n_src") > 1), ("STEP_CAUSAL_ORDER_VIOLATION", late)], entity="step_id")
    d = requires.join(m.select(*key, "context_id", "action_o0"), key)
    par = m.select("work_id", F.col("step_id").alias("dep_id"), F.col("context_id").alias("p_ctx"), F.col("result_o1").alias("p_end"))
    d = d.join(par, ["work_id", "dep_id"], "left")
    bad3 = fd.checks(
        d,
        [
            ("STEP_DEPENDENCY_UNKNOWN_OR_SELF", F.col("p_end").isNull() | (F.col("dep_id") == F.col("step_id"))),
            ("DEPENDENCY_CONTEXT_MISMATCH", F.col("p_ctx") != F.col("context_id")), ("STEP_DEPENDENCY_ORDER_VIOLATION", F.col("p_end") > F.col("action_o0")),
        ],
        entity=F.concat_ws(">", "step_id", "dep_id"),
    )
    c = cues.join(m.select(*key, "result_o0", "result_o1"), key, "left")
    bad4 = fd.checks(c, [("CUE_STEP_UNKNOWN", F.col("result_o0").isNull()), ("RESULT_CUE_OUTSIDE_EVIDENCE_WINDOW", (F.col("start_us") < F.col("result_o0")) | (F.col("end_us") > F.col("result_o1")))], entity="cue_id")
    out = m.select(*key, "context_id", *[f"{x}_{n}" for x in ROLES for n in ("o0", "o1")])
    return out, fd.union([bad, bad2, bad3, bad4])


def evidence_map(units: DataFrame, occurrences: DataFrame, carriers: DataFrame, timeline: DataFrame, retime: bool = False, tol_us: int = 0, counted: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """TL19: where each evidence unit plays, through its carriers in order.

    Parts must cover the unit exactly, in source order, back to back in the output.
    ``units``: work_id, unit_id, source_id, start_us, end_us.  ``carriers``: work_id,
    occurrence_id, carrier_id (a clip of ``timeline``).  ``counted``: carriers that cost less to count.
    """
    t = timeline.select("work_id", F.col("clip_id").alias("carrier_id"), F.col("source_id").alias("c_src"), F.col("start_us").alias("c0"), F.col("eff_source_end_us").alias("c1"), "speed_num", "speed_den", "out_start_us")
    u = units.select("work_id", "unit_id", "source_id", F.col("start_us").alias("u0"), F.col("end_us").alias("u1"))
    p = carriers.join(occurrences.select(*OCC, "unit_id"), OCC).join(u, ["work_id", "unit_id"]).join(t, ["work_id", "carrier_id"], "left")
    s0, s1 = F.greatest("u0", "c0"), F.least("u1", "c1")
    p = p.withColumn("s0", s0).withColumn("s1", s1)
    p = p.withColumn("o0", F.col("out_start_us") + half_even(wide(F.col("s0") - F.col("c0"), "speed_den"), "speed_num"))
    p = p.withColumn("o1", F.col("out_start_us") + half_even(wide(F.col("s1") - F.col("c0"), "speed_den"), "speed_num"))
    one = fd.checks(
        p,
        [
            ("CARRIER_MISSING_OR_MUTED", F.col("c0").isNull()), ("EVIDENCE_SOURCE_MISMATCH", F.col("c_src") != F.col("source_id")),
            ("CARRIER_DOES_NOT_COVER_UNIT", F.col("s1") <= F.col("s0")), ("EVIDENCE_RETIMED_CARRIER_UNSUPPORTED", F.lit(not retime) & (F.col("speed_num") != F.col("speed_den"))),
        ],
        entity=F.concat_ws("/", "occurrence_id", "carrier_id"),
    )
    good = p.where("c_src = source_id and s1 > s0")
    q = scan(good, OCC, ["o0", "carrier_id"], by_time("o0"), lags={"__ps": F.col("s1"), "__po": F.col("o1")}, within=carriers if counted is None else counted)
    broken = (F.abs(F.col("s0") - F.coalesce("__ps", F.col("u0"))) > tol_us)
    jump = F.abs(F.col("o0") - F.col("__po")) > tol_us
    g = q.groupBy(*OCC, "unit_id").agg(
        F.bool_or(broken).alias("__bad"), F.bool_or(F.coalesce(jump, F.lit(False))).alias("__jump"), F.max_by("s1", F.struct("o0", "carrier_id")).alias("__end"), F.max("u1").alias("__u1"),
        F.min("o0").alias("out_start_us"), F.max("o1").alias("out_end_us"), F.count(F.lit(1)).alias("n_parts"),
    )
    cut = F.col("__bad") | (F.abs(F.col("__end") - F.col("__u1")) > tol_us)
    two = fd.checks(g, [("EVIDENCE_TRUNCATED_REORDERED_OR_REPEATED", cut), ("EVIDENCE_OUTPUT_DISCONTINUITY", F.col("__jump"))], entity="occurrence_id")
    return g.select(*OCC, "unit_id", "out_start_us", "out_end_us", "n_parts"), one.unionByName(two)


def check_dependencies(mapped: DataFrame, requires: DataFrame, deps: DataFrame) -> DataFrame:
    """TL20: an occurrence binds exactly the units its unit requires; prerequisites end
    before it starts.

    ``mapped``: work_id, occurrence_id, unit_id, out_start_us, out_end_us.
    ``requires``: work_id, unit_id, dep_unit_id, relation.  ``deps``: work_id,
    occurrence_id, dep_unit_id, dep_occurrence_id.
    """
    need = mapped.select(*OCC, "unit_id", "out_start_us").join(requires, ["work_id", "unit_id"])
    # the two sides of a full join one by one: rows that lie by work stay where they are
    j = need.join(deps, [*OCC, "dep_unit_id"], "left")
    extra = deps.join(need.select(*OCC, "dep_unit_id"), [*OCC, "dep_unit_id"], "left_anti")
    pair = F.concat_ws(">", "occurrence_id", "dep_unit_id")
    a = fd.finding(j, "DEPENDENCY_BINDING_MISMATCH", F.col("unit_id").isNull() | F.col("dep_occurrence_id").isNull(), pair)
    a = a.unionByName(fd.finding(extra, "DEPENDENCY_BINDING_MISMATCH", F.lit(True), pair))
    par = mapped.select("work_id", F.col("occurrence_id").alias("dep_occurrence_id"), F.col("unit_id").alias("p_unit"), F.col("out_end_us").alias("p_end"))
    k = j.where("unit_id is not null and dep_occurrence_id is not null").join(par, ["work_id", "dep_occurrence_id"], "left")
    b = fd.checks(
        k,
        [
            ("DEPENDENCY_OCCURRENCE_MISSING_OR_SELF", F.col("p_unit").isNull() | (F.col("dep_occurrence_id") == F.col("occurrence_id"))),
            ("DEPENDENCY_OCCURRENCE_WRONG_UNIT", F.col("p_unit") != F.col("dep_unit_id")),
            ("PREREQUISITE_NOT_BEFORE_UNIT", (F.col("relation") == "prerequisite") & (F.col("p_end") > F.col("out_start_us"))),
        ],
        entity=pair,
    )
    return a.unionByName(b)


def missing_required(required: DataFrame, occurrences: DataFrame) -> DataFrame:
    """TL21: required units without an occurrence."""
    return required.join(occurrences.select("work_id", "unit_id"), ["work_id", "unit_id"], "left_anti")


def chapters(members: DataFrame, mapped: DataFrame, counted: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """TL22: chapter spans from their occurrences, and findings.

    ``members``: work_id, chapter_id, ord, occurrence_id.  ``counted``: members that cost less to count.
    """
    m = mapped.select(*OCC, "out_start_us", "out_end_us")
    j = members.join(m, OCC, "left")
    n = members.groupBy(*OCC).agg(F.count(F.lit(1)).alias("n"))
    a = fd.finding(n, "CHAPTER_DUPLICATE_OCCURRENCE", F.col("n") > 1, F.col("occurrence_id"))
    b = fd.finding(j, "CHAPTER_OCCURRENCE_UNKNOWN", F.col("out_start_us").isNull(), F.concat_ws("/", "chapter_id", "occurrence_id"))
    has = members.select("work_id").distinct()
    lost = m.join(has, "work_id", "left_semi").join(members.select(*OCC), OCC, "left_anti")
    c = fd.finding(lost, "UNCHAPTERED_OCCURRENCE", F.lit(True), F.col("occurrence_id"))
    g = j.groupBy("work_id", "chapter_id", "ord").agg(F.min("out_start_us").alias("start_us"), F.max("out_end_us").alias("end_us"), F.count("out_start_us").alias("n_occurrences"))
    s = scan(g, ["work_id"], ["ord"], by_rows("ord"), lags={"__p": F.col("start_us")}, within=members if counted is None else counted)
    d = fd.finding(s, "CHAPTER_ORDER_INVALID", F.col("start_us") < F.col("__p"), F.col("chapter_id"))
    return g, fd.union([a, b, c, d])


def layer_hits(mapped: DataFrame, layers: DataFrame, fps_num: int, fps_den: int, bin_us: int = BIN_US, counted: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """TL23: visible layers over each occurrence, listed in z order.

    ``counted``: equal tables of both that cost less to measure.
    """
    us = lambda c: half_even(wide(c, US, fps_den), F.lit(fps_num))

    def sides(mapped, layers):
        y = layers.where("opacity > 0").select("work_id", "layer_id", "z", us("start_frame").alias("b_start_us"), us("end_frame").alias("b_end_us"))
        m = mapped.select(*OCC, F.col("out_start_us").alias("start_us"), F.col("out_end_us").alias("end_us"))
        return m.where("end_us > start_us"), y.where("b_end_us > b_start_us")

    m = mapped.select(*OCC)
    p = interval_join(*sides(mapped, layers), ["work_id"], bin_us=bin_us, counted=sides(*counted) if counted else None)
    g = p.groupBy(*OCC).agg(F.transform(F.array_sort(F.collect_list(F.struct("z", "layer_id"))), lambda x: x["layer_id"]).alias("layer_ids"))
    return m.join(g, OCC, "left").withColumn("layer_ids", F.coalesce("layer_ids", F.array().cast("array<string>")))


PHASES = ["setup", "action", "outcome"]


def event_map(events: DataFrame, roles: DataFrame, mapped: DataFrame) -> tuple[DataFrame, DataFrame]:
    """TL24: event spans from phase occurrences, and findings.

    ``events``: work_id, event_id, ord, mode (complete/open/replay), replay_of.
    ``roles``: work_id, event_id, role, occurrence_id.
    """
    key = ["work_id", "event_id"]
    m = mapped.select(*OCC, "out_start_us", "out_end_us")
    r = roles.join(m, OCC, "left")
    g = r.groupBy(*key).agg(
        *[F.min(F.when(F.col("role") == p, F.col("out_start_us"))).alias(f"{p}_0") for p in PHASES], *[F.max(F.when(F.col("role") == p, F.col("out_end_us"))).alias(f"{p}_1") for p in PHASES],
        F.min("out_start_us").alias("out_start_us"), F.max("out_end_us").alias("out_end_us"),
    )
    e = events.join(g, key, "left")
    lo, hi = None, F.lit(False)
    for p in PHASES:
        if lo is not None:
            hi = hi | F.coalesce(F.col(f"{p}_0") < lo, F.lit(False))
        lo = F.col(f"{p}_1") if lo is None else F.coalesce(F.col(f"{p}_1"), lo)
    org = e.select("work_id", F.col("event_id").alias("replay_of"), F.col("ord").alias("__o"), F.col("mode").alias("__m"), F.col("out_end_us").alias("__e"))
    e = e.join(org, ["work_id", "replay_of"], "left")
    replay = F.col("mode") == "replay"
    twice = roles.groupBy(*OCC).agg(F.count(F.lit(1)).alias("n"))
    bad = fd.union([
        fd.finding(twice, "EVENT_OCCURRENCE_ALREADY_ASSIGNED", F.col("n") > 1, F.col("occurrence_id")),
        fd.finding(r, "EVENT_OCCURRENCE_UNKNOWN", F.col("out_start_us").isNull(), F.concat_ws("/", "event_id", "occurrence_id")),
        fd.finding(m.join(roles.select(*OCC), OCC, "left_anti"), "UNASSIGNED_EVENT_OCCURRENCE", F.lit(True), F.col("occurrence_id")),
        fd.checks(
            e,
            [
                ("EVENT_ACTION_REQUIRED", F.col("action_0").isNull()),
                ("COMPLETE_EVENT_NEEDS_SETUP_AND_OUTCOME", (F.col("mode") == "complete") & (F.col("setup_0").isNull() | F.col("outcome_0").isNull())),
                ("EVENT_PHASE_ORDER_VIOLATION", hi),
                ("REPLAY_ORIGINAL_MISSING_OR_NOT_PRIOR", replay & (F.col("__o").isNull() | (F.col("__o") >= F.col("ord")) | (F.col("__m") == "replay"))),
                ("REPLAY_PRECEDES_ORIGINAL_END", replay & (F.col("action_0") < F.col("__e"))),
                ("PRIMARY_EVENT_CANNOT_DECLARE_REPLAY", ~replay & F.col("replay_of").isNotNull()),
            ],
            entity="event_id",
        ),
    ])
    return e.select(*key, "mode", F.when(replay, F.col("replay_of")).otherwise(F.col("event_id")).alias("canonical_id"), "out_start_us", "out_end_us"), bad


def event_counts(event_rows: DataFrame) -> DataFrame:
    """TL24: primary, replay and open counts per work."""
    m = F.col("mode")
    return event_rows.groupBy("work_id").agg(F.count_if(m != "replay").alias("n_primary"), F.count_if(m == "replay").alias("n_replay"), F.count_if(m == "open").alias("n_open"))


def replay_cover(actions: DataFrame, labels: DataFrame) -> DataFrame:
    """TL25: replay labels must say so and cover every action span.

    ``actions``: work_id, event_id, occurrence_id, start_us, end_us.  ``labels``: work_id,
    event_id, caption_id, start_us, end_us, text.
    """
    a = fd.finding(labels, "EXPLICIT_REPLAY_TEXT_REQUIRED", ~F.col("text").rlike(tx.REPLAY_LABEL), F.col("caption_id"))
    t = actions.withColumn("target_id", F.col("occurrence_id"))
    holes = iv.coverage(labels, t, ["work_id", "event_id"])[1].select("work_id", F.col("target_id")).distinct()
    return a.unionByName(fd.finding(holes, "REPLAY_LABEL_NOT_COVERING_ACTION", F.lit(True), F.col("target_id")))


def compile_localization(units: DataFrame, cues: DataFrame, omissions: DataFrame, protected: DataFrame, profile: dict, dub: bool = False) -> DataFrame:
    """TL26: findings of a translated cue set.

    ``units``: work_id, unit_id, speaker_id.  ``cues``: work_id, cue_id, unit_ids,
    speaker_ids, start_us, end_us, text and audio_us when dubbed.  ``omissions`` and
    ``protected``: work_id, unit_id.
    """
    key = ["work_id", "unit_id"]
    used = cues.select("work_id", "cue_id", F.explode("unit_ids").alias("unit_id"))
    known = used.join(units.select(*key, "speaker_id"), key, "left")
    spk = known.groupBy("work_id", "cue_id").agg(F.array_sort(F.collect_set("speaker_id")).alias("want"))
    c = cues.join(spk, ["work_id", "cue_id"], "left")
    n, longest, chars, over = tx.reading_limits("text", F.col("end_us") - F.col("start_us"), profile["max_lines"], profile["max_line"], profile["max_cps"], profile.get("count_spaces", False))
    lane = scan(cues, ["work_id"], ["start_us", "end_us", "cue_id"], by_time("start_us"), lags={"__p": F.col("end_us")})
    parts = [
        fd.finding(known, "CUE_SOURCE_UNKNOWN", F.col("speaker_id").isNull(), F.concat_ws("/", "cue_id", "unit_id")),
        fd.finding(used.join(omissions, key, "left_semi"), "SOURCE_BOTH_USED_AND_OMITTED", F.lit(True), F.concat_ws("/", "cue_id", "unit_id")),
        fd.finding(protected.join(omissions, key, "left_semi"), "PROTECTED_SOURCE_OMITTED", F.lit(True), F.col("unit_id")),
        fd.finding(units.join(used.select(*key), key, "left_anti").join(omissions, key, "left_anti"), "SOURCE_COVERAGE_INCOMPLETE", F.lit(True), F.col("unit_id")),
        fd.finding(c, "SPEAKER_MAPPING_MISMATCH", F.array_sort("speaker_ids") != F.coalesce("want", F.array().cast("array<string>")), F.col("cue_id")),
        fd.finding(lane, "OVERLAPPING_TARGET_CUES", F.col("start_us") < F.col("__p"), F.col("cue_id")),
        fd.finding(c.withColumn("__over", over), "READING_PROFILE_EXCEEDED", F.size("__over") > 0, F.col("cue_id"), severity="warning", blocking=False, evidence=F.array_join("__over", ",")),
    ]
    if dub:
        parts.append(fd.finding(c, "DUB_EXCEEDS_SLOT", F.col("audio_us") > F.col("end_us") - F.col("start_us"), F.col("cue_id")))
    return fd.union(parts)


def caption_cover(requirements: DataFrame, captions: DataFrame, links: DataFrame, tol_us: int = 0) -> DataFrame:
    """TL27: declared text and window coverage by chosen captions.

    ``requirements``: work_id, req_id, text, match, start_us, end_us, min_us.
    ``links``: work_id, req_id, caption_id.
    """
    key = ["work_id", "req_id"]
    c = captions.select("work_id", "caption_id", F.col("text").alias("__t"), F.col("start_us").alias("c0"), F.col("end_us").alias("c1"))
    j = links.join(requirements, key).join(c, ["work_id", "caption_id"], "left")
    same = F.when(F.col("match") == "exact", F.col("__t") == F.col("text")).otherwise(F.contains("__t", "text"))
    a = fd.checks(j, [("CAPTION_ID_UNKNOWN", F.col("__t").isNull()), ("CAPTION_TEXT_MISMATCH", ~same)], entity=F.concat_ws("/", "req_id", "caption_id"))
    parts = j.select(*key, F.greatest("start_us", "c0").alias("s"), F.least("end_us", "c1").alias("e")).where("e > s").select(*key, F.col("s").alias("start_us"), F.col("e").alias("end_us"))
    m = iv.merge_spans(parts, key, tol_us).groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min("start_us").alias("m0"), F.max("end_us").alias("m1"), F.max(F.col("end_us") - F.col("start_us")).alias("longest"))
    r = requirements.join(m, key, "left")
    full = (F.col("n") == 1) & (F.col("m0") <= F.col("start_us") + tol_us) & (F.col("m1") >= F.col("end_us") - tol_us)
    b = fd.checks(
        r,
        [
            ("MINIMUM_EXCEEDS_WINDOW", F.col("min_us") > F.col("end_us") - F.col("start_us")), ("CAPTION_WINDOW_NOT_COVERED", ~F.coalesce(full, F.lit(False))),
            ("CONTINUOUS_DURATION_TOO_SHORT", F.coalesce("longest", F.lit(0)) < F.col("min_us")),
        ],
        entity="req_id",
    )
    return a.unionByName(b)


def cue_alignment(checks: DataFrame, markers: DataFrame, tracks: DataFrame, timeline: DataFrame) -> DataFrame:
    """TL28 and SG14: picture frame against audio marker; uncertainty is carried along.

    ``checks``: work_id, check_id, track_id, marker_id, clip_id, frame_offset, want_us,
    tol_us.  ``markers``: work_id, marker_id, t_us, uncertainty_us.  ``tracks``: work_id,
    track_id, start_us, end_us, out_start_us.
    """
    t = timeline.select("work_id", "clip_id", "out_start_frame", "frames", "fps_num", "fps_den")
    j = checks.join(markers, ["work_id", "marker_id"], "left").join(tracks.select("work_id", "track_id", F.col("start_us").alias("a0"), F.col("end_us").alias("a1"), F.col("out_start_us").alias("ao")), ["work_id", "track_id"], "left")
    j = j.join(t, ["work_id", "clip_id"], "left")
    frame = F.col("out_start_frame") + F.col("frame_offset")
    visual = half_even(wide(frame, US, "fps_den"), "fps_num")
    audio = F.col("ao") + F.col("t_us") - F.col("a0")
    error = visual - audio - F.col("want_us")
    state = (
        F.when(F.col("t_us").isNull(), "MARKER_UNKNOWN").when(F.col("a0").isNull(), "AUDIO_TRACK_UNKNOWN").when(F.col("frames").isNull(), "CLIP_UNKNOWN")
        .when((F.col("t_us") < F.col("a0")) | (F.col("t_us") > F.col("a1")), "MARKER_OUTSIDE_SELECTED_AUDIO")
        .when((F.col("frame_offset") < 0) | (F.col("frame_offset") > F.col("frames")), "FRAME_OFFSET_INVALID")
        .when(F.abs(error) <= F.col("tol_us"), "ALIGNED").otherwise("MISALIGNED")
    )
    return j.select("work_id", "check_id", frame.alias("frame"), visual.alias("visual_us"), audio.alias("audio_us"), error.alias("error_us"), state.alias("state"), (F.col("frame_offset") == F.col("frames")).alias("boundary"), "uncertainty_us")
