"""Quality rules: each yields finding rows; a clean work yields none.

Rules take tables keyed by ``work_id`` and run for all works at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanframe.functions import fixed
from spanframe.functions.clock import wide
from spanframe.operators import intervals as iv
from spanframe.operators.select import hook_eligibility
from spanframe.operators.text import RELIABLE, adjacent_similarity
from spanframe.operators.timeline import consume_visuals, first_use, nominal_timeline, segment_durations
from spanframe.functions import text as tx
from spanframe.plans import findings as fd
from spanframe.plans.bins import BIN_US, interval_join
from spanframe.plans.ordered import by_rows, scan
from spanframe.plans.rounds import written

SEVERE = ["warning", "error", "critical"]
WORK_SEG = ["work_id", "segment_id"]


def status(findings: DataFrame, works: DataFrame) -> DataFrame:
    """QC0: BLOCKED, DEGRADED or PASSED per work."""
    g = findings.groupBy("work_id").agg(F.bool_or("blocking").alias("b"), F.bool_or(F.col("severity").isin(SEVERE)).alias("w"), F.count(F.lit(1)).alias("n_findings"))
    out = works.select("work_id").join(g, "work_id", "left")
    state = F.when(F.coalesce("b", F.lit(False)), "BLOCKED").when(F.coalesce("w", F.lit(False)), "DEGRADED").otherwise("PASSED")
    return out.select("work_id", state.alias("status"), F.coalesce("n_findings", F.lit(0)).alias("n_findings"))


def tri_state(checks: DataFrame, keys: list[str]) -> DataFrame:
    """QC00: reject over unknown over accept."""
    g = checks.groupBy(*keys).agg(F.bool_or(F.col("state") == "reject").alias("r"), F.bool_or(F.col("state") == "unknown").alias("u"))
    return g.select(*keys, F.when(F.col("r"), "reject").when(F.col("u"), "unknown").otherwise("accept").alias("state"))


def rule_detection(detection: DataFrame, reviews: DataFrame, allow_failure: bool = True) -> DataFrame:
    """QC1: fallback detection and a semantic review that did not run."""
    a = fd.finding(detection, "SCENE_DETECTION_FALLBACK", F.col("fallback_reason").isNotNull(), F.col("source_id"), source="source_id", severity="warning", blocking=False, evidence=F.col("fallback_reason"))
    b = fd.finding(reviews, "SEMANTIC_QC_NOT_RUN", F.col("status") == "not_run", F.col("work_id"), severity="warning", blocking=False)
    c = fd.finding(reviews, "SEMANTIC_QC_UNAVAILABLE", F.col("status") == "unavailable", F.col("work_id"), severity="warning", blocking=not allow_failure)
    return fd.union([a, b, c])


def rule_visual_evidence(segments: DataFrame, visuals: DataFrame, pool: DataFrame, slack_us: int = 1000) -> DataFrame:
    """QC2: voice visuals must name a pool unit of their source and stay inside it;
    a unit whose fingerprint is not current is no evidence."""
    v = visuals.join(segments.where("mode = 'voiceover'").select(*WORK_SEG), WORK_SEG)
    p = pool.select("unit_id", F.col("source_id").alias("ps"), F.col("start_us").alias("p0"), F.col("end_us").alias("p1"), F.col("current").alias("pc"))
    v = v.join(p, "unit_id", "left")
    why = (
        F.when(F.col("ps").isNull(), "unknown unit")
        .when(~F.col("pc"), "stale fingerprint")
        .when(F.col("ps") != F.col("source_id"), "source differs")
        .when((F.col("start_us") < F.col("p0") - slack_us) | (F.col("end_us") > F.col("p1") + slack_us), "range leaves unit")
    )
    return fd.finding(v.withColumn("why", why), "VISUAL_EVIDENCE_INVALID", F.col("why").isNotNull(), F.concat_ws("/", "segment_id", "ord"), source="source_id", evidence=F.col("why"))


def rule_source_identity(manifest: DataFrame, board: DataFrame, fields: list[str], tol_us: int = 1000) -> DataFrame:
    """QC3: repeated ids on either side, ids on one side only, differing fields."""
    dup = fd.union([t.groupBy("work_id", "source_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("work_id", "source_id") for t in (manifest, board)])
    a = fd.finding(dup, "DUPLICATE_SOURCE_ID", F.lit(True), F.col("source_id"), source="source_id", severity="critical")
    m = manifest.select("work_id", "source_id", F.lit(True).alias("__m"), *[F.col(f).alias(f"m_{f}") for f in fields])
    b = board.select("work_id", "source_id", F.lit(True).alias("__b"), *[F.col(f).alias(f"b_{f}") for f in fields])
    j = m.join(b, ["work_id", "source_id"], "full")

    def differs(f):
        if f == "duration_us":
            return F.abs(F.col(f"m_{f}") - F.col(f"b_{f}")) > tol_us
        return ~F.col(f"m_{f}").eqNullSafe(F.col(f"b_{f}"))

    both = F.col("__m").isNotNull() & F.col("__b").isNotNull()
    names = F.array_join(F.array_compact(F.array(*[F.when(both & differs(f), F.lit(f)) for f in fields])), ",")
    why = F.when(F.col("__b").isNull(), "missing on board").when(F.col("__m").isNull(), "missing in manifest").when(names != "", names)
    return a.unionByName(fd.finding(j.withColumn("why", why), "SOURCE_IDENTITY_MISMATCH", F.col("why").isNotNull(), F.col("source_id"), source="source_id", severity="critical", evidence=F.col("why")))


def rule_story_confidence(characters: DataFrame, stories: DataFrame, char_min: float = 0.68, story_min: float = 0.72) -> DataFrame:
    """QC4: open identity conflicts, low character and story confidence."""
    soft = {"blocking": False, "deterministic": False}
    a = fd.finding(stories, "UNRESOLVED_CHARACTER_CONFLICT", F.col("n_conflicts") > 0, F.col("work_id"), severity="error", evidence=F.col("n_conflicts"), **soft)
    low = characters.where(F.col("confidence") < char_min).groupBy("work_id").agg(F.count(F.lit(1)).alias("n"))
    b = fd.finding(low, "LOW_CHARACTER_CONFIDENCE", F.lit(True), F.col("work_id"), severity="warning", evidence=F.col("n"), **soft)
    c = fd.finding(stories, "LOW_STORY_CONFIDENCE", F.col("confidence") < story_min, F.col("work_id"), severity="warning", **soft)
    return fd.union([a, b, c])


def rule_event_refs(events: DataFrame, characters: DataFrame, spans: DataFrame, sources: DataFrame, tol_us: int = 20_000) -> DataFrame:
    """QC5: participants must be registered; evidence must lie inside its source."""
    p = events.select("work_id", "event_id", F.explode("participants").alias("character_id")).join(characters.select("work_id", "character_id"), ["work_id", "character_id"], "left_anti")
    a = fd.finding(p, "EVENT_UNKNOWN_CHARACTER", F.lit(True), F.col("event_id"), severity="critical", evidence=F.col("character_id"))
    s = spans.join(sources.select("source_id", "duration_us"), "source_id", "left")
    out = F.col("duration_us").isNull() | (F.col("start_us") < 0) | (F.col("end_us") > F.col("duration_us") + tol_us)
    return a.unionByName(fd.finding(s, "EVENT_EVIDENCE_OUT_OF_BOUNDS", out, F.col("event_id"), source="source_id", severity="critical"))


def rule_references(beats: DataFrame, events: DataFrame, highlights: DataFrame, segments: DataFrame, visuals: DataFrame, sources: DataFrame) -> DataFrame:
    """QC6: unknown events, highlights, beats and sources.

    ``beats``: work_id, beat_id, event_ids, highlight_ids.
    """
    def lost(df, ref, known, key, rule, severity="critical", entity="beat_id", source=None):
        k = known.select("work_id", F.col(key).alias(ref)) if "work_id" in known.columns else known.select(F.col(key).alias(ref))
        on = [c for c in k.columns]
        return fd.finding(df.where(F.col(ref).isNotNull()).join(k.distinct(), on, "left_anti"), rule, F.lit(True), F.col(entity), severity=severity, evidence=F.col(ref), source=source)

    be = beats.select("work_id", "beat_id", F.explode("event_ids").alias("ref"))
    bh = beats.select("work_id", "beat_id", F.explode("highlight_ids").alias("ref"))
    used = consume_visuals(segments, visuals)
    return fd.union([
        lost(be, "ref", events, "event_id", "BEAT_UNKNOWN_EVENT"),
        lost(bh, "ref", highlights, "highlight_id", "BEAT_UNKNOWN_HIGHLIGHT"),
        lost(segments.withColumn("ref", F.col("beat_id")), "ref", beats, "beat_id", "STORYBOARD_UNKNOWN_BEAT", entity="segment_id"),
        lost(segments.withColumn("ref", F.col("highlight_id")), "ref", highlights, "highlight_id", "UNKNOWN_HIGHLIGHT", "error", "segment_id"),
        lost(used.withColumn("ref", F.col("source_id")), "ref", sources, "source_id", "UNKNOWN_SOURCE", entity="segment_id", source="source_id"),
    ])


def rule_rights(works: DataFrame, segments: DataFrame) -> DataFrame:
    """QC7: publishing without confirmed rights; declared reuse where it is switched off."""
    a = fd.finding(works, "RIGHTS_NOT_CONFIRMED", (F.col("publish_mode") == "publish") & ~F.col("rights_confirmed"), F.col("work_id"), severity="critical")
    off = segments.join(works.where("not allow_hook_reuse").select("work_id"), "work_id")
    return a.unionByName(fd.finding(off, "HOOK_REUSE_DISABLED", F.col("allow_reuse"), F.col("segment_id"), severity="critical"))


def rule_voice(segments: DataFrame, visuals: DataFrame, has_audio: str = "has_audio") -> DataFrame:
    """QC8: text, audio and picture length of voiced segments."""
    s = segment_durations(segments, visuals).where("mode = 'voiceover'")
    no_audio = ~F.col(has_audio)
    v = F.coalesce("voice_us", F.lit(0))
    a = fd.finding(s, "EMPTY_SEGMENT_TEXT", tx.strip("text") == "", F.col("segment_id"))
    b = fd.checks(
        s,
        [("MISSING_TTS_AUDIO", no_audio), ("INVALID_TTS_DURATION", ~no_audio & (v <= 0)), ("VISUAL_SHORTER_THAN_TTS", (v > 0) & (F.col("visual_us") + 1000 < v))],
        entity="segment_id", severity="critical",
    )
    return a.unionByName(b)


def rule_original_captions(segments: DataFrame, visuals: DataFrame, cues: DataFrame, words: DataFrame, verified: DataFrame, slack_us: int = 1000, bin_us: int = BIN_US) -> DataFrame:
    """QC9: unverified captions, more than one visual, cut cues without reliable words."""
    o = segment_durations(segments, visuals).where("mode = 'original'")
    ok = verified.select(*WORK_SEG, F.col("cues_verified").alias("__ok"))
    o = o.join(ok, WORK_SEG, "left")
    a = fd.finding(o, "ORIGINAL_CAPTIONS_UNVERIFIED", ~F.coalesce("__ok", F.lit(False)), F.col("segment_id"), blocking=False)
    b = fd.finding(o, "ORIGINAL_NOT_CONTIGUOUS", F.col("n_visuals") != 1, F.col("segment_id"), severity="critical")
    v = visuals.join(o.select(*WORK_SEG), WORK_SEG).select(*WORK_SEG, "ord", "source_id", "start_us", "end_us")
    c = cues.select("source_id", "cue_id", F.col("start_us").alias("b_start_us"), F.col("end_us").alias("b_end_us"))
    cut = (F.col("b_start_us") < F.col("start_us") - slack_us) | (F.col("b_end_us") > F.col("end_us") + slack_us)
    p = interval_join(v, c, ["source_id"], bin_us=bin_us, where=cut)
    w = words.where(F.col("timing").isin(RELIABLE)).select("source_id", "cue_id", F.col("start_us").alias("w0"), F.col("end_us").alias("w1"))
    ident = [*WORK_SEG, "ord", "source_id", "cue_id"]
    good = p.join(w, ["source_id", "cue_id"]).where((F.col("w0") >= F.col("start_us") - slack_us) & (F.col("w1") <= F.col("end_us") + slack_us)).select(*ident).distinct()
    bare = p.select(*ident).join(good, ident, "left_anti")
    d = fd.finding(bare, "PARTIAL_ORIGINAL_CAPTION_UNTIMED", F.lit(True), F.col("segment_id"), source="source_id", severity="warning", blocking=False, evidence=F.col("cue_id"))
    return fd.union([a, b, d])


def rule_duplication(segments: DataFrame, threshold: float = 0.72) -> DataFrame:
    """QC10: neighbouring voice and original segments that say the same."""
    s = adjacent_similarity(segments, threshold)
    return fd.finding(s, "ADJACENT_VO_ORIGINAL_DUPLICATION", F.lit(True), F.col("segment_id"), severity="warning", blocking=False, evidence=F.col("previous"))


def rule_source_ranges(segments: DataFrame, visuals: DataFrame, sources: DataFrame, tol_us: int = 20_000, reuse_us: int = 200_000) -> DataFrame:
    """QC11: played ranges outside their source, and undeclared reuse of source time."""
    used = consume_visuals(segments, visuals).join(segments.select(*WORK_SEG, F.col("ord").alias("seg_ord"), "allow_reuse"), WORK_SEG)
    used = written(used.select(*WORK_SEG, "seg_ord", "ord", "allow_reuse", "source_id", "start_us", "end_us"), "played")  # read by the ranges and, when measured and joined, by both sides of the reuse
    r = used.join(sources.select("source_id", "duration_us"), "source_id")
    out = (F.col("start_us") < 0) | (F.col("end_us") > F.col("duration_us") + tol_us) | (F.col("end_us") <= F.col("start_us"))
    a = fd.finding(r, "SOURCE_RANGE_OUT_OF_BOUNDS", out, F.concat_ws("/", "segment_id", "ord"), source="source_id", severity="critical")
    # a pair is allowed when either side allows reuse, so only forbidding rows can meet
    strict = used.where("not allow_reuse").select("work_id", "source_id", F.struct("seg_ord", "ord", "segment_id").alias("at"), "start_us", "end_us")
    again = iv.find_reuse(strict, ["work_id", "source_id"], "at", reuse_us)
    b = fd.finding(again, "UNDECLARED_SOURCE_REUSE", F.lit(True), F.concat_ws("/", "at.segment_id", "at.ord"), source="source_id", evidence=F.col("overlap_us"))
    return a.unionByName(b)


def rule_dialogue_boundary(segments: DataFrame, visuals: DataFrame, cues: DataFrame, max_us: int = 450_000, guard_us: int = 20_000) -> DataFrame:
    """QC12: an original cut must not split a cue; dialogue must start and end at cues."""
    v = visuals.join(segments.where("mode = 'original'").select(*WORK_SEG, "audio_owner"), WORK_SEG)
    first = v.groupBy(*WORK_SEG).agg(F.min_by(F.struct("source_id", "start_us", "end_us", "audio_owner"), "ord").alias("v")).select(*WORK_SEG, "v.*")
    first = written(first.withColumn("vid", F.concat_ws("/", *WORK_SEG)), "first_visuals")  # a row per original segment, read by two snaps and two cuts
    snap = iv.snap_nearest(first, cues, ["source_id"], max_us, "vid")
    talk = F.col("audio_owner") == "original_dialogue"
    spoken = cues.where(tx.strip("text") != "")

    def cut(side):
        p = first.select("source_id", "vid", F.col(side).alias("t_us"))
        return iv.cut_points(p, spoken, ["source_id"], guard_us).select("vid").distinct().withColumn(f"cut_{side}", F.lit(True))

    j = snap.join(cut("start_us"), "vid", "left").join(cut("end_us"), "vid", "left").na.fill(False, ["cut_start_us", "cut_end_us"])
    # a source without cues gives no safe side, as with no transcript
    bad_in = F.col("cut_start_us") | (talk & ~F.col("entry_safe"))
    bad_out = F.col("cut_end_us") | (talk & ~F.col("exit_safe"))
    why = F.concat_ws(",", F.when(bad_in, "entry"), F.when(bad_out, "exit"))
    return fd.finding(j.withColumn("why", why), "UNSAFE_DIALOGUE_BOUNDARY", F.col("why") != "", F.col("segment_id"), source="source_id", severity="critical", evidence=F.col("why"))


def metrics(segments: DataFrame, visuals: DataFrame, plan: DataFrame, long_us: int = 15_000_000) -> DataFrame:
    """QC16: one preflight row per work."""
    s = segment_durations(segments, visuals)
    orig = F.col("mode") == "original"
    g = s.groupBy("work_id").agg(
        F.count(F.lit(1)).alias("n_segments"), F.sum("dur_us").alias("timeline_us"), F.sum(F.when(orig, F.col("dur_us")).otherwise(0)).alias("original_us"),
        F.count_if(orig & (F.col("dur_us") > long_us)).alias("n_long_originals"),
    )
    return plan.join(g, "work_id", "left").na.fill(0, ["n_segments", "timeline_us", "original_us", "n_long_originals"])


def rule_budget(segments: DataFrame, visuals: DataFrame, plan: DataFrame) -> DataFrame:
    """QC13: empty timeline, original share, target drift, too many long originals.

    ``plan``: work_id, target_us, ratio_low_pct, ratio_high_pct, max_long.
    """
    m = metrics(segments, visuals, plan)
    t, o, goal = F.col("timeline_us"), F.col("original_us"), F.col("target_us")
    drift = F.abs(t - goal)
    a = fd.finding(m, "EMPTY_TIMELINE", t <= 0, F.col("work_id"), severity="critical")
    b = fd.finding(m, "ORIGINAL_RATIO_OUTSIDE_BUDGET", (t > 0) & ((o * 100 < t * F.col("ratio_low_pct")) | (o * 100 > t * F.col("ratio_high_pct"))), F.col("work_id"), severity="warning", blocking=False)
    c = fd.finding(m, "TARGET_DURATION_DRIFT", (t > 0) & (drift > 45_000_000) & (drift * 4 > goal), F.col("work_id"), blocking=drift * 2 > goal)
    d = fd.finding(m, "TOO_MANY_LONG_ORIGINALS", F.col("n_long_originals") > F.col("max_long"), F.col("work_id"), severity="warning", blocking=False)
    return fd.union([a, b, c, d])


def rule_hook(segments: DataFrame, visuals: DataFrame, highlights: DataFrame, plan: DataFrame, events: DataFrame, spans: DataFrame, knowledge: DataFrame, deadline_us: int = 6_000_000, counted: tuple[DataFrame, DataFrame, DataFrame, DataFrame] | None = None) -> DataFrame:
    """QC14: the planned hook must be played, first, early and be allowed to come first.

    ``plan``: work_id, hook_id.  ``segments.highlight_id`` is the declared highlight,
    ``hook_preposed`` marks preposed segments.  ``counted``: segments, visuals, highlights
    and spans that cost less to measure.
    """
    seg, vis, high, spn = counted or [None] * 4
    use = first_use(segments, visuals, highlights, counted=(vis, high) if counted else None)
    clock = nominal_timeline(segments, visuals, counted=seg).select(*WORK_SEG, F.col("ord").alias("seg_ord"), "out_start_us", "highlight_id")
    first = clock.groupBy("work_id").agg(F.min("seg_ord").alias("__f"))
    used = use.withColumnRenamed("highlight_id", "used_id").join(clock, WORK_SEG).join(plan.select("work_id", "hook_id"), "work_id").join(first, "work_id")
    at_open = used.where((F.col("seg_ord") == F.col("__f")) & (F.col("used_id") == F.col("highlight_id")))
    a = fd.finding(at_open, "HOOK_MISMATCH", F.col("used_id") != F.col("hook_id"), F.col("segment_id"), severity="warning", blocking=False)
    known = highlights.select("work_id", F.col("highlight_id").alias("hook_id"), F.lit(True).alias("__known"))
    claims = clock.join(plan.select("work_id", "hook_id"), "work_id").join(known, ["work_id", "hook_id"]).where("highlight_id = hook_id")
    played = used.where("used_id = hook_id")
    empty = claims.join(played.select(*WORK_SEG), WORK_SEG, "left_anti")
    b = fd.finding(empty, "HOOK_REFERENCE_WITHOUT_SOURCE_EVIDENCE", F.lit(True), F.col("segment_id"))
    start = played.groupBy("work_id").agg(F.min_by(F.col("out_start_us") + F.col("offset_us"), "seg_ord").alias("hook_us"))
    p = plan.join(start, "work_id", "left").join(first, "work_id")
    c = fd.finding(p, "HOOK_NOT_USED", F.col("hook_us").isNull(), F.col("work_id"), evidence=F.col("hook_id"))
    d = fd.finding(p, "HOOK_TOO_LATE", F.col("hook_us") > deadline_us, F.col("work_id"), blocking=False, evidence=F.col("hook_us"))
    hooks = highlights.join(plan.select("work_id", F.col("hook_id").alias("highlight_id")), ["work_id", "highlight_id"])
    elig = hook_eligibility(hooks, events, spans, knowledge, counted=(high, spn) if counted else None).where("not eligible")
    pre = segments.where("hook_preposed").select("work_id").distinct()
    e = fd.finding(elig.join(pre, "work_id"), "UNSAFE_HOOK_PREPOSE", F.lit(True), F.col("highlight_id"), evidence=F.col("reason"))
    return fd.union([a, b, c, d, e])


def rule_long_runs(segments: DataFrame, visuals: DataFrame, voice_us: int = 45_000_000, original_us: int = 60_000_000) -> DataFrame:
    """QC15: longest stretch of one mode."""
    s = segment_durations(segments, visuals)
    s = scan(s, ["work_id"], ["ord"], by_rows("ord"), lags={"__p": F.col("mode")}, within=segments)
    s = s.withColumn("__new", (F.col("__p").isNull() | (F.col("__p") != F.col("mode"))).cast("bigint"))
    s = scan(s, ["work_id"], ["ord"], by_rows("ord"), sums={"__run": F.col("__new")}, within=segments)
    r = s.groupBy("work_id", "mode", "__run").agg(F.sum("dur_us").alias("us")).groupBy("work_id", "mode").agg(F.max("us").alias("us"))
    limit = F.when(F.col("mode") == "original", original_us).otherwise(voice_us)
    rule = F.when(F.col("mode") == "original", "LONG_CONTINUOUS_ORIGINAL").otherwise("LONG_CONTINUOUS_VOICEOVER")
    return fd.finding(r, rule, F.col("us") > limit, F.col("work_id"), severity="warning", blocking=False, evidence=F.col("us"))


def codec_of(encoder):
    """Codec identity of an encoder name."""
    table = F.create_map(*[F.lit(x) for kv in fixed.CODEC_OF_ENCODER.items() for x in kv])
    out = F.try_element_at(table, encoder)
    for p in fixed.CODEC_PREFIXES:
        out = F.coalesce(out, F.when(F.startswith(encoder, F.lit(p + "_")), p))
    return F.coalesce(out, encoder)


def rule_probe(facts: DataFrame, expected: DataFrame, tol_us: int = 1_200_000) -> DataFrame:
    """QC17: delivered file against the render settings.

    ``facts``: work_id, has_reference, file_bytes, sha256, has_video, width, height,
    rate_num, rate_den, video_codec, has_audio, audio_codec, sample_rate, channels,
    duration_us.  ``expected``: work_id, width, height, fps_num, fps_den, video_encoder,
    audio_encoder, duration_us, sha256.  Without a file no further rule applies.
    """
    e = expected.select("work_id", *[F.col(c).alias(f"x_{c}") for c in expected.columns if c != "work_id"])
    j = e.join(facts, "work_id", "left")
    ref = F.coalesce("has_reference", F.lit(False))
    there = ref & (F.coalesce("file_bytes", F.lit(0)) > 0)
    v, a = there & F.coalesce("has_video", F.lit(False)), there & F.coalesce("has_audio", F.lit(False))
    # |rate - fps| > max(0.02, fps/1000), in integers over rate_den * fps_den
    off = F.abs(wide("rate_num", "x_fps_den") - wide("x_fps_num", "rate_den"))
    far = (off * 50 > wide("rate_den", "x_fps_den")) & (off * 1000 > wide("x_fps_num", "rate_den"))
    severe = fd.checks(
        j,
        [
            ("MISSING_OUTPUT_REFERENCE", ~ref), ("MISSING_FINAL_VIDEO", ref & ~there), ("RENDER_ARTIFACT_MISMATCH", there & (F.col("x_sha256") != F.col("sha256"))),
            ("MISSING_VIDEO_STREAM", there & ~v), ("MISSING_AUDIO_STREAM", there & ~a),
            ("OUTPUT_DIMENSION_MISMATCH", v & ((F.col("width") != F.col("x_width")) | (F.col("height") != F.col("x_height")))),
        ],
        entity="work_id", severity="critical",
    )
    plain = fd.checks(
        j,
        [
            ("OUTPUT_FPS_MISMATCH", v & (F.coalesce("rate_den", F.lit(0)) <= 0)), ("OUTPUT_FPS_MISMATCH", v & (F.col("rate_den") > 0) & far),
            ("OUTPUT_VIDEO_CODEC_MISMATCH", v & (F.col("video_codec") != codec_of(F.col("x_video_encoder")))),
            ("OUTPUT_AUDIO_CODEC_MISMATCH", a & (F.col("audio_codec") != codec_of(F.col("x_audio_encoder")))),
            ("OUTPUT_AUDIO_FORMAT_MISMATCH", a & ((F.col("sample_rate") != 48_000) | (F.col("channels") != 2))),
            ("OUTPUT_DURATION_MISMATCH", there & (F.abs(F.col("duration_us") - F.col("x_duration_us")) > tol_us)),
        ],
        entity="work_id",
    )
    return severe.unionByName(plain)


def rule_realized(clock: DataFrame, clock_findings: DataFrame, fps_num: int, fps_den: int) -> DataFrame:
    """QC18: works with an invalid measured clock, and totals off by more than a frame."""
    bad = clock_findings.select("work_id").distinct()
    a = fd.finding(bad, "INVALID_REALIZED_TIMELINE", F.lit(True), F.col("work_id"))
    t = clock.groupBy("work_id").agg(F.max("end_frame").alias("f"), F.max("nominal_end_us").alias("n"))
    off = F.abs(wide("f", 1_000_000, fps_den) - wide("n", fps_num)) > wide(1_000_000, fps_den)
    return a.unionByName(fd.finding(t, "NOMINAL_FRAME_QUANTIZATION", off, F.col("work_id"), severity="warning", blocking=False))


def rule_subtitles(file_cues: DataFrame, expected: DataFrame, works: DataFrame, max_lines: int = 2, max_line: int = 16) -> DataFrame:
    """QC19: delivered captions equal the expected ones by position within 2 ms.

    Both cue tables: work_id, pos (1-based), start_us, end_us, text.  ``works``: work_id,
    duration_us, has_file, burn_required, burn_applied, n_estimated.
    """
    e = expected.select("work_id", "pos", F.col("start_us").alias("e0"), F.col("end_us").alias("e1"), tx.strip("text").alias("et"))
    j = file_cues.select("work_id", "pos", "start_us", "end_us", "text").join(e, ["work_id", "pos"], "full")
    j = j.join(works.where("has_file").select("work_id", "duration_us"), "work_id")
    miss = F.col("e0").isNull() | F.col("start_us").isNull() | (F.abs(F.col("start_us") - F.col("e0")) > 2000) | (F.abs(F.col("end_us") - F.col("e1")) > 2000) | (F.col("text") != F.col("et"))
    f = scan(file_cues, ["work_id"], ["pos"], by_rows("pos"), lags={"__s": F.col("start_us"), "__e": F.col("end_us")}).join(works.select("work_id", "duration_us"), "work_id")
    disorder = (F.col("start_us") < F.col("__s")) | (F.col("end_us") > F.col("duration_us") + 50_000) | (F.col("start_us") < F.col("__e") - 1000)
    bad = j.where(miss).select("work_id").unionByName(f.where(disorder).select("work_id")).distinct()
    a = fd.finding(bad, "INVALID_SUBTITLE_FILE", F.lit(True), F.col("work_id"))
    b = fd.finding(works, "MISSING_SUBTITLE_FILE", ~F.col("has_file"), F.col("work_id"))
    lines = F.split("text", "\n", -1)
    hard = (F.col("end_us") - F.col("start_us") < 350_000)
    wideline = (F.size(lines) > max_lines) | F.exists(lines, lambda s: F.length(s) > max_line)
    both = f.withColumn("w", F.explode(F.array_compact(F.array(F.when(hard, "short"), F.when(wideline, "layout")))))
    c = fd.finding(both, "SUBTITLE_READABILITY_RISK", F.lit(True), F.concat_ws("#", "work_id", "pos"), severity="warning", blocking=False, evidence=F.col("w"))
    d = fd.finding(works, "VO_CAPTIONS_ESTIMATED", F.col("n_estimated") > 0, F.col("work_id"), severity="warning", blocking=False, evidence=F.col("n_estimated"))
    has = expected.select("work_id").distinct()
    g = fd.finding(works.join(has, "work_id"), "SUBTITLE_BURN_UNVERIFIED", F.col("burn_required") & ~F.col("burn_applied"), F.col("work_id"))
    return fd.union([a, b, c, d, g])


def rule_review(ranges: DataFrame, works: DataFrame) -> DataFrame:
    """QC20: picture and sound review must each cover the work. ``ranges`` adds ``kind``."""
    parts = []
    for kind in ("visual", "audio"):
        c = iv.review_cover(ranges.where(F.col("kind") == kind), works)
        parts.append(fd.finding(c, f"{kind.upper()}_REVIEW_NOT_VERIFIED", ~F.col("checked"), F.col("work_id"), severity="warning", blocking=False))
    return fd.union(parts)


def rule_signal_share(ratios: DataFrame, works: DataFrame, kind: str, limit: float) -> DataFrame:
    """QC21: too much black or silence; works without signal rows were not scanned."""
    over, none, block = {
        "black": ("EXCESSIVE_BLACK_FRAMES", "BLACK_SCAN_UNAVAILABLE", True),
        "silence": ("EXCESSIVE_SILENCE", "SILENCE_SCAN_UNAVAILABLE", False),
    }[kind]
    a = fd.finding(ratios, over, F.col("ratio") > limit, F.col("work_id"), blocking=block, evidence=F.col("ratio"))
    lost = works.join(ratios.select("work_id"), "work_id", "left_anti")
    return a.unionByName(fd.finding(lost, none, F.lit(True), F.col("work_id"), severity="warning", blocking=False))


def boundary_checks(proposals: DataFrame, units: DataFrame, refs: DataFrame, sources: DataFrame, candidates: DataFrame) -> DataFrame:
    """QC22: structural checks of moved boundaries, as (proposal_id, check, state) rows.

    ``proposals``: proposal_id, candidate_id, candidate_revision, source_id,
    source_sha256, start_us, end_us, ctx_start_us, ctx_end_us, timebase_ok (NULL =
    unverified).  ``refs``: proposal_id, ord, unit_id, unit_revision.  ``units``:
    unit_id, source_id, start_us, end_us, revision.
    """
    s = sources.select("source_id", F.col("sha256").alias("s_sha"), F.col("duration_us").alias("s_dur"))
    c = candidates.select(F.col("candidate_id"), F.col("revision").alias("c_rev"), F.col("source_id").alias("c_src"))
    p = proposals.join(s, "source_id", "left").join(c, "candidate_id", "left")

    def st(ok):
        return F.when(F.coalesce(ok, F.lit(False)), "accept").otherwise("reject")

    ctx = F.coalesce((F.col("ctx_start_us") <= F.col("start_us")) & (F.col("ctx_end_us") >= F.col("end_us")), F.lit(False))
    one = p.select(
        "proposal_id",
        F.explode(
            F.array(
                F.struct(F.lit("source_identity").alias("check"), st((F.col("s_sha") == F.col("source_sha256")) & (F.col("c_src") == F.col("source_id"))).alias("state")),
                F.struct(F.lit("candidate_revision").alias("check"), st(F.col("c_rev") == F.col("candidate_revision")).alias("state")),
                F.struct(F.lit("source_range").alias("check"), st(F.col("end_us") <= F.col("s_dur")).alias("state")),
                F.struct(F.lit("timebase").alias("check"), F.when(F.col("timebase_ok").isNull(), "unknown").otherwise(st(F.col("timebase_ok"))).alias("state")),
                F.struct(F.lit("context").alias("check"), F.when(ctx, "accept").otherwise("unknown").alias("state")),
            )
        ).alias("x"),
    ).select("proposal_id", "x.*")
    u = units.select("unit_id", F.col("source_id").alias("u_src"), F.col("start_us").alias("u0"), F.col("end_us").alias("u1"), "revision")
    r = refs.join(proposals.select("proposal_id", "source_id", F.col("start_us").alias("p0"), F.col("end_us").alias("p1")), "proposal_id").join(u, "unit_id", "left")
    r = r.withColumn("ok", F.coalesce((F.col("u_src") == F.col("source_id")) & (F.col("revision") == F.col("unit_revision")), F.lit(False)))
    lineage = r.select("proposal_id", F.concat(F.lit("unit:"), "unit_id").alias("check"), st(F.col("ok")).alias("state"))
    dup = refs.groupBy("proposal_id", "unit_id").agg(F.count(F.lit(1)).alias("n")).groupBy("proposal_id").agg(F.max("n").alias("n"))
    unique = dup.select("proposal_id", F.lit("unique_units").alias("check"), st(F.col("n") == 1).alias("state"))
    good = r.where("ok")
    o = scan(good, ["proposal_id"], ["ord"], by_rows("ord"), lags={"__p": F.struct("u0", "u1", "unit_id")})
    order = o.groupBy("proposal_id").agg(F.bool_or(F.col("__p") > F.struct("u0", "u1", "unit_id")).alias("x")).select("proposal_id", F.lit("unit_order").alias("check"), st(~F.coalesce("x", F.lit(False))).alias("state"))
    t = proposals.select("source_id", F.col("proposal_id").alias("target_id"), "start_us", "end_us")
    # coverage is per proposal: only its own valid units count
    parts = good.select(F.col("proposal_id").alias("target_id"), F.greatest("u0", "p0").alias("start_us"), F.least("u1", "p1").alias("end_us")).where("end_us > start_us")
    holes = iv._holes(iv.merge_spans(parts, ["target_id"]).select("target_id", "start_us", "end_us"), t.drop("source_id"), ["target_id"])
    open_ = holes.select(F.col("target_id").alias("proposal_id")).distinct().withColumn("h", F.lit(True))
    cover = proposals.select("proposal_id").join(open_, "proposal_id", "left").select("proposal_id", F.lit("coverage").alias("check"), F.when(F.col("h").isNotNull(), "unknown").otherwise("accept").alias("state"))
    return fd.union([one, lineage, unique, order, cover])


def node_checks(required: DataFrame, observations: DataFrame, proposals: DataFrame) -> DataFrame:
    """QC22, semantic part (advisory): the folded state of usable observations per node."""
    o = observations.join(proposals.select("proposal_id", "start_us", "end_us"), "proposal_id").where("has_evidence and obs_start_us >= start_us and obs_end_us <= end_us")
    g = tri_state(o, ["proposal_id", "node"]).withColumnRenamed("state", "s")
    j = required.join(g, ["proposal_id", "node"], "left")
    return j.select("proposal_id", F.concat(F.lit("semantic:"), "node").alias("check"), F.coalesce("s", F.lit("unknown")).alias("state"))


def claim_verdicts(claims: DataFrame, assets: DataFrame, gaps: DataFrame, observations: DataFrame) -> DataFrame:
    """QC23: may a claim's judgment stand?  Unknown wins over it with a reason list.

    ``claims``: claim_id, claim_type, extra_modalities, required_nodes, judgment.
    ``assets``: claim_id, modality, kind.  ``gaps``: claim_id, modality.
    ``observations``: claim_id, node, modality, relation.
    """
    table = F.create_map(*[x for k, v in fixed.CLAIM_MODALITIES.items() for x in (F.lit(k), F.array(*[F.lit(m) for m in v]))])
    need = F.array_union(F.coalesce(F.try_element_at(table, F.col("claim_type")), F.array().cast("array<string>")), F.col("extra_modalities"))
    none = F.array().cast("array<string>")
    a = assets.groupBy("claim_id").agg(F.collect_set("modality").alias("have"), F.bool_or(F.col("kind") == "video_clip").alias("clip"))
    g = gaps.groupBy("claim_id").agg(F.collect_set("modality").alias("gap"))
    o = observations.groupBy("claim_id").agg(
        F.collect_set("modality").alias("seen"), F.collect_set(F.when(F.col("relation") != "insufficient", F.col("node"))).alias("nodes"),
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("relation") != "support").alias("n_other"), F.count_if(F.col("relation") == "contradict").alias("n_contra"),
    )
    c = claims.withColumn("need", need).join(a, "claim_id", "left").join(g, "claim_id", "left").join(o, "claim_id", "left").na.fill(0, ["n", "n_other", "n_contra"])
    c = c.select("*", *[F.coalesce(x, none).alias(f"_{x}") for x in ("have", "gap", "seen", "nodes")])
    moving = F.col("claim_type").isin("action", "sequence", "causality")
    reasons = F.array_compact(
        F.array(
            F.when(F.size(F.array_except("need", "_have")) > 0, "missing_modalities"),
            F.when(F.size("_gap") > 0, "raw_coverage_gap"),
            F.when(moving & ~F.coalesce("clip", F.lit(False)), "continuous_video_not_observed"),
            F.when(F.array_contains("need", "audio") & F.array_contains("_gap", "audio"), "independent_audio_coverage_gap"),
            F.when((moving | (F.col("claim_type") == "speaker")) & F.array_contains("_gap", "video"), "independent_video_coverage_gap"),
            F.when(F.size("required_nodes") == 0, "required_nodes_not_specified"),
            F.when(F.col("claim_type") == "motivation", "internal_motivation_not_directly_observable"),
            F.when(F.size(F.array_except("need", "_seen")) > 0, "required_modality_not_observed_by_reviewer"),
            F.when(F.size(F.array_except("required_nodes", "_nodes")) > 0, "required_claim_nodes_not_covered"),
            F.when((F.col("judgment") == "accept") & ((F.col("n") == 0) | (F.col("n_other") > 0)), "accept_without_consistent_located_support"),
            F.when((F.col("judgment") == "reject") & (F.col("n_contra") == 0), "reject_without_located_contradiction"),
        )
    )
    return c.select("claim_id", F.when(F.size(reasons) > 0, "unknown").otherwise(F.col("judgment")).alias("verdict"), F.array_join(reasons, ";").alias("reasons"))


def rule_story_integrity(events: DataFrame, spans: DataFrame, knowledge: DataFrame) -> DataFrame:
    """QC24: events without source evidence; knowledge of unknown events."""
    key = ["work_id", "event_id"]
    a = fd.finding(events.join(spans.select(*key), key, "left_anti"), "EVENT_WITHOUT_EVIDENCE", F.lit(True), F.col("event_id"))
    b = fd.finding(knowledge.join(events.select(*key), key, "left_anti"), "KNOWLEDGE_UNKNOWN_EVENT", F.lit(True), F.col("event_id"))
    return a.unionByName(b)


def readiness(cases: DataFrame, gold: DataFrame, reviewers: DataFrame, keep: DataFrame) -> DataFrame:
    """QC25: is a benchmark case ready for review?

    ``cases``: case_id, material_sha (NULL = missing).  ``gold``: case_id, source_sha256,
    duration_us, n_facts, has_reveal.  ``keep``: case_id, start_us, end_us, reason.
    """
    r = reviewers.where(tx.strip("name") != "").groupBy("case_id").agg(F.count_distinct("name").alias("n_rev"))
    k = keep.join(gold.select("case_id", F.col("duration_us").alias("gd")), "case_id")
    bad = (F.col("start_us") < 0) | (F.col("start_us") >= F.col("end_us")) | (F.col("end_us") > F.col("gd"))
    k = k.groupBy("case_id").agg(F.count(F.lit(1)).alias("n_keep"), F.bool_or(F.coalesce(bad, F.lit(True))).alias("bad"), F.bool_or(F.coalesce("reason", F.lit("")) == "").alias("bare"))
    j = cases.join(gold, "case_id", "left").join(r, "case_id", "left").join(k, "case_id", "left").na.fill(0, ["n_rev", "n_keep"])
    g = F.col("source_sha256").isNotNull()
    issues = F.array_compact(
        F.array(
            F.when(F.col("material_sha").isNull(), "missing_source_material"), F.when(~g, "missing_human_gold"), F.when(g & (F.col("n_rev") < 2), "two_named_reviewers_required"),
            F.when(g & ((F.col("n_facts") == 0) | (F.col("n_keep") == 0)), "incomplete_gold_annotations"), F.when(g & ~F.col("has_reveal"), "missing_reveal_annotations"),
            F.when(g & (F.col("duration_us") <= 0), "invalid_source_duration"), F.when(g & F.col("bad"), "invalid_highlight_boundary"), F.when(g & F.col("bare"), "incomplete_highlight_annotation"),
            F.when(g & (F.col("material_sha") != F.col("source_sha256")), "source_gold_fingerprint_mismatch"),
        )
    )
    return j.select("case_id", F.when(F.size(issues) > 0, "NOT_READY").otherwise("READY_FOR_REVIEW").alias("status"), F.array_join(F.array_sort(issues), ",").alias("issues"))


def boundary_adoption(proposals: DataFrame, events: DataFrame, spans: DataFrame, declared: DataFrame, segments: DataFrame, visuals: DataFrame, bin_us: int = BIN_US, counted: tuple[DataFrame, DataFrame, DataFrame] | None = None) -> DataFrame:
    """QC26: what adopting a moved boundary would break.

    ``proposals``: work_id, highlight_id, source_id, old_start_us, old_end_us, start_us,
    end_us, min_out_us, max_out_us, protected.  ``declared``: work_id, highlight_id,
    event_id, newly (declared contained events, newly exposed ones marked).  ``counted``:
    proposals, spans and segments that cost less to measure.
    """
    key = ["work_id", "highlight_id"]

    def inside(a, b):
        def sides(proposals, spans):
            s = spans.select("work_id", "event_id", "source_id", F.col("start_us").alias("b_start_us"), F.col("end_us").alias("b_end_us"))
            return proposals.select(*key, "source_id", F.col(a).alias("start_us"), F.col(b).alias("end_us")), s

        return interval_join(*sides(proposals, spans), ["work_id", "source_id"], bin_us=bin_us, counted=sides(*counted[:2]) if counted else None).select(*key, "event_id").distinct()

    now, before = inside("start_us", "end_us"), inside("old_start_us", "old_end_us")
    new = now.join(before.withColumn("__old", F.lit(True)), [*key, "event_id"], "left").select(*key, "event_id", F.col("__old").isNull().alias("is_new"))
    d = declared.select(*key, "event_id", "newly")
    j = new.join(d, [*key, "event_id"], "full")
    a = fd.finding(j, "EVENT_RANGE_RECONCILIATION_REQUIRED", F.col("is_new").isNull() | F.col("newly").isNull(), F.col("highlight_id"), evidence=F.col("event_id"))
    b = fd.finding(j, "REVEAL_RANGE_RECONCILIATION_REQUIRED", F.col("is_new") != F.col("newly"), F.col("highlight_id"), evidence=F.col("event_id"))
    c = fd.finding(proposals, "PROTECTED_HIGHLIGHT", F.col("protected"), F.col("highlight_id"))
    clock = nominal_timeline(segments, visuals, counted=counted[2] if counted else None).select(*WORK_SEG, "mode", "highlight_id", "out_start_us")
    s = clock.join(proposals, key)
    e = fd.finding(s, "OUTPUT_REVEAL_POSITION_CONFLICT", (F.col("out_start_us") < F.col("min_out_us")) | (F.col("out_start_us") > F.col("max_out_us")), F.col("segment_id"))
    v = visuals.groupBy(*WORK_SEG).agg(F.count(F.lit(1)).alias("nv"), F.min("start_us").alias("v0"), F.max("end_us").alias("v1"))
    m = s.where("mode = 'original'").join(v, WORK_SEG, "left")
    hand = (F.coalesce("nv", F.lit(0)) != 1) | (F.col("v0") != F.col("old_start_us")) | (F.col("v1") != F.col("old_end_us"))
    f = fd.finding(m, "MANUAL_ORIGINAL_RANGE_CONFLICT", hand, F.col("segment_id"))
    return fd.union([a, b, c, e, f])


def evidence_cards(declared: DataFrame, cards: DataFrame, proposals: DataFrame, modalities: list[str]) -> DataFrame:
    """QC27: declared and present cards must be the same set with equal hashes and
    source, and each needed modality must cover the proposed range.

    ``declared``: proposal_id, card_id, card_sha.  ``cards``: proposal_id, card_id,
    card_sha, source_id, modality, start_us, end_us.
    """
    key = ["proposal_id", "card_id"]
    have = cards.select(*key, F.col("card_sha").alias("h"), F.col("source_id").alias("cs")).distinct()
    j = declared.join(have, key, "full").join(proposals.select("proposal_id", F.col("source_id").alias("ps")), "proposal_id")
    why = F.when(F.col("card_sha").isNull() | F.col("h").isNull(), "CARD_SET_MISMATCH").when(F.col("card_sha") != F.col("h"), "CARD_HASH_CHANGED").when(F.col("cs") != F.col("ps"), "CARD_SOURCE_MISMATCH")
    a = j.withColumn("rule_id", why).where("rule_id is not null").select("proposal_id", F.col("card_id").alias("entity_id"), "rule_id")
    parts = [a]
    for m in modalities:
        t = proposals.select("proposal_id", F.lit(m).alias("target_id"), "start_us", "end_us")
        holes = iv.coverage(cards.where(F.col("modality") == m).select("proposal_id", "start_us", "end_us"), t, ["proposal_id"])[1]
        parts.append(holes.select("proposal_id", F.col("target_id").alias("entity_id"), F.lit(f"{m.upper()}_COVERAGE_UNKNOWN").alias("rule_id")).distinct())
    return fd.union(parts)
