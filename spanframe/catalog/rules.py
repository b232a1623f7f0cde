"""Queries of the quality rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanframe import fixtures as fx
from spanframe.catalog.cte import sql
from spanframe.catalog.registry import query
from spanframe.catalog.retrieve import _events, _highlights, _known, _spans, stored_cut
from spanframe.catalog.text import WORDS, words
from spanframe.catalog.timeline import NOMINAL, REALIZED, USED, facts
from spanframe.operators import rules as ru
from spanframe.operators import signals as sg
from spanframe.operators import timeline as tl
from spanframe.plans import findings as fd
from spanframe.plans.ordered import lying
from spanframe.plans.rounds import written

TWO = ["entity_id", "rule_id"]


def orders(spark, d):
    return fx.table(spark, d, "orders")


def works(spark, d):
    return fx.segments(spark, d).select("work_id").distinct()


def _basic(spark, d):
    """A small pack: references, ranges, budget."""
    s, v, src = fx.segments(spark, d), fx.visuals(spark, d), fx.sources(spark, d)
    plan = works(spark, d).select("work_id", F.lit(100_000_000).cast("bigint").alias("target_us"), F.lit(25).alias("ratio_low_pct"), F.lit(45).alias("ratio_high_pct"), F.lit(2).alias("max_long"))
    return fd.union([ru.rule_source_ranges(s, v, src), ru.rule_budget(s, v, plan), ru.rule_long_runs(s, v)])


BUDGET = (
    NOMINAL
    + """, m AS (SELECT work_id, CAST(sum(dur_us) AS BIGINT) AS t, CAST(sum(CASE WHEN mode = 'original' THEN dur_us ELSE 0 END) AS BIGINT) AS o, count(*) AS n, count(CASE WHEN mode = 'original' AND dur_us > 15000000 THEN 1 END) AS nl FROM nominal GROUP BY 1),
  budget AS (SELECT work_id, work_id AS entity_id, 'EMPTY_TIMELINE' AS rule_id, true AS blocking FROM m WHERE t <= 0 UNION ALL SELECT work_id, work_id, 'ORIGINAL_RATIO_OUTSIDE_BUDGET', false FROM m WHERE t > 0 AND (o*100 < t*25 OR o*100 > t*45)
   UNION ALL SELECT work_id, work_id, 'TARGET_DURATION_DRIFT', abs(t - 100000000)*2 > 100000000 FROM m WHERE t > 0 AND abs(t - 100000000) > 45000000 AND abs(t - 100000000)*4 > 100000000
   UNION ALL SELECT work_id, work_id, 'TOO_MANY_LONG_ORIGINALS', false FROM m WHERE nl > 2)"""
)
RANGES = """pl AS (SELECT u.work_id, u.segment_id, u.ord, u.source_id, u.start_us, u.start_us + u.used_us AS end_us, s.ord AS so, s.allow_reuse FROM used u JOIN segments s ON s.segment_id = u.segment_id),
  ranges AS (SELECT pl.work_id, pl.segment_id || '/' || pl.ord AS entity_id, 'SOURCE_RANGE_OUT_OF_BOUNDS' AS rule_id, true AS blocking FROM pl JOIN sources USING (source_id) WHERE end_us > duration_us + 20000 OR end_us <= start_us
   UNION ALL SELECT DISTINCT a.work_id, a.segment_id || '/' || a.ord, 'UNDECLARED_SOURCE_REUSE', true FROM pl a JOIN pl b ON a.work_id = b.work_id AND a.source_id = b.source_id AND (b.so, b.ord) < (a.so, a.ord) AND NOT a.allow_reuse AND NOT b.allow_reuse
    AND least(a.end_us, b.end_us) - greatest(a.start_us, b.start_us) > 200000)"""
LONG = """lr AS (SELECT *, CASE WHEN lag(mode) OVER (PARTITION BY work_id ORDER BY ord) IS DISTINCT FROM mode THEN 1 ELSE 0 END AS nw FROM nominal), lg AS (SELECT *, sum(nw) OVER (PARTITION BY work_id ORDER BY ord) AS run FROM lr),
  lm AS (SELECT work_id, mode, max(us) AS us FROM (SELECT work_id, mode, run, sum(dur_us) AS us FROM lg GROUP BY 1, 2, 3) GROUP BY 1, 2),
  long AS (SELECT work_id, work_id AS entity_id, CASE WHEN mode = 'original' THEN 'LONG_CONTINUOUS_ORIGINAL' ELSE 'LONG_CONTINUOUS_VOICEOVER' END AS rule_id, false AS blocking FROM lm WHERE us > CASE WHEN mode = 'original' THEN 60000000 ELSE 45000000 END)"""
PACK = f"{BUDGET}, {USED}, {RANGES}, {LONG}, pack AS (SELECT * FROM budget UNION ALL SELECT * FROM ranges UNION ALL SELECT * FROM long)"

query("rules_pack", sql(PACK + " SELECT work_id, entity_id, rule_id, blocking FROM pack", "segments", "visuals", "sources"))(
    lambda s, d: _basic(s, d).select("work_id", "entity_id", "rule_id", "blocking")
)
query(
    "work_status",
    sql(
        PACK + """ SELECT w.work_id, CASE WHEN bool_or(coalesce(blocking, false)) THEN 'BLOCKED' WHEN count(rule_id) > 0 THEN 'DEGRADED' ELSE 'PASSED' END AS status, count(rule_id) AS n_findings
     FROM (SELECT DISTINCT work_id FROM segments) w LEFT JOIN pack USING (work_id) GROUP BY 1""",
        "segments", "visuals", "sources",
    ),
)(lambda s, d: ru.status(_basic(s, d), works(s, d)))


@query(
    "preflight_metrics",
    sql(BUDGET + " SELECT work_id, n AS n_segments, t AS timeline_us, o AS original_us, nl AS n_long_originals FROM m", "segments", "visuals"),
)
def preflight_metrics(spark, d):
    return ru.metrics(fx.segments(spark, d), fx.visuals(spark, d), works(spark, d))


@query(
    "tri_state_fold",
    """SELECT l_orderkey, CASE WHEN bool_or(l_returnflag = 'R') THEN 'reject' WHEN bool_or(l_returnflag = 'N') THEN 'unknown' ELSE 'accept' END AS state FROM lineitem GROUP BY 1""",
)
def tri_state_fold(spark, d):
    st = F.when(F.col("l_returnflag") == "R", "reject").when(F.col("l_returnflag") == "N", "unknown").otherwise("accept")
    return ru.tri_state(fx.table(spark, d, "lineitem").select("l_orderkey", st.alias("state")), ["l_orderkey"])


@query(
    "rule_detection",
    """SELECT CAST(c_custkey AS VARCHAR) AS entity_id, 'SCENE_DETECTION_FALLBACK' AS rule_id FROM customer WHERE c_nationkey % 6 = 0 UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'SEMANTIC_QC_NOT_RUN' FROM customer WHERE c_mktsegment = 'MACHINERY'
     UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'SEMANTIC_QC_UNAVAILABLE' FROM customer WHERE c_mktsegment = 'BUILDING'""",
)
def rule_detection(spark, d):
    c = fx.table(spark, d, "customer").withColumn("work_id", F.col("c_custkey").cast("string"))
    det = c.select("work_id", F.col("work_id").alias("source_id"), F.when(F.col("c_nationkey") % 6 == 0, "no_usable_scenes").alias("fallback_reason"))
    rev = c.select("work_id", F.when(F.col("c_mktsegment") == "MACHINERY", "not_run").when(F.col("c_mktsegment") == "BUILDING", "unavailable").otherwise("checked").alias("status"))
    return ru.rule_detection(det, rev).select(*TWO)


@query(
    "rule_visual_evidence",
    sql(
        """p AS (SELECT unit_id, min(source_id) AS ps, min(start_us) AS p0, max(end_us) AS p1, min(ord) % 3 <> 0 AS pc FROM visuals WHERE ord % 4 <> 0 GROUP BY 1)
     SELECT v.segment_id || '/' || v.ord AS entity_id, CASE WHEN ps IS NULL THEN 'unknown unit' WHEN NOT pc THEN 'stale fingerprint' WHEN ps <> v.source_id THEN 'source differs' ELSE 'range leaves unit' END AS evidence
     FROM visuals v JOIN segments s ON s.segment_id = v.segment_id AND s.mode = 'voiceover' LEFT JOIN p USING (unit_id) WHERE ps IS NULL OR NOT pc OR ps <> v.source_id OR v.start_us < p0 - 1000 OR v.end_us > p1 + 1000""",
        "segments", "visuals",
    ),
)
def rule_visual_evidence(spark, d):
    v = fx.visuals(spark, d)
    p = v.where("ord % 4 <> 0").groupBy("unit_id").agg(F.min("source_id").alias("source_id"), F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"), (F.min("ord") % 3 != 0).alias("current"))
    return ru.rule_visual_evidence(fx.segments(spark, d), v, p).select("entity_id", "evidence")


@query(
    "rule_source_identity",
    """WITH m AS (SELECT CAST(c_nationkey AS VARCHAR) AS work_id, CAST(c_custkey % 900 AS VARCHAR) AS source_id, c_custkey AS k, c_mktsegment AS g FROM customer),
     b AS (SELECT work_id, source_id, CASE WHEN k % 11 = 0 THEN 'X' ELSE g END AS g FROM m WHERE k % 17 <> 0),
     dup AS (SELECT work_id, source_id FROM m GROUP BY 1, 2 HAVING count(*) > 1 UNION ALL SELECT work_id, source_id FROM b GROUP BY 1, 2 HAVING count(*) > 1)
     SELECT source_id AS entity_id, 'DUPLICATE_SOURCE_ID' AS rule_id, '' AS evidence FROM dup UNION ALL
     SELECT source_id, 'SOURCE_IDENTITY_MISMATCH', CASE WHEN b.g IS NULL THEN 'missing on board' WHEN m.g IS NULL THEN 'missing in manifest' ELSE 'tag' END FROM m FULL JOIN b USING (work_id, source_id) WHERE m.g IS DISTINCT FROM b.g""",
)
def rule_source_identity(spark, d):
    c = fx.table(spark, d, "customer")
    m = c.select(F.col("c_nationkey").cast("string").alias("work_id"), (F.col("c_custkey") % 900).cast("string").alias("source_id"), F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("tag"))
    b = m.where("k % 17 <> 0").withColumn("tag", F.when(F.col("k") % 11 == 0, "X").otherwise(F.col("tag")))
    return ru.rule_source_identity(m, b, ["tag"]).select("entity_id", "rule_id", "evidence")


@query(
    "rule_story_confidence",
    """WITH w AS (SELECT c_nationkey AS w, count(CASE WHEN c_acctbal < 0 THEN 1 END) AS n, count(CASE WHEN c_custkey % 100 < 68 THEN 1 END) AS low FROM customer GROUP BY 1)
     SELECT CAST(w AS VARCHAR) AS work_id, 'UNRESOLVED_CHARACTER_CONFLICT' AS rule_id FROM w WHERE n > 0 UNION ALL SELECT CAST(w AS VARCHAR), 'LOW_CHARACTER_CONFIDENCE' FROM w WHERE low > 0 UNION ALL SELECT CAST(w AS VARCHAR), 'LOW_STORY_CONFIDENCE' FROM w WHERE w % 10 < 7""",
)
def rule_story_confidence(spark, d):
    c = fx.table(spark, d, "customer").withColumn("work_id", F.col("c_nationkey").cast("string"))
    st = c.groupBy("work_id").agg(F.count_if(F.col("c_acctbal") < 0).alias("n_conflicts"), (F.max("c_nationkey") % 10 / 10 + 0.05).alias("confidence"))
    return ru.rule_story_confidence(c.select("work_id", (F.col("c_custkey") % 100 / 100).alias("confidence")), st).select("work_id", "rule_id")


@query(
    "rule_event_refs",
    sql(
        """SELECT segment_id AS entity_id, 'EVENT_UNKNOWN_CHARACTER' AS rule_id FROM segments WHERE ord % 9 = 5 UNION ALL SELECT segment_id, 'EVENT_EVIDENCE_OUT_OF_BOUNDS' FROM visuals LEFT JOIN sources USING (source_id) WHERE duration_us IS NULL OR end_us > duration_us + 20000""",
        "segments", "visuals", "sources",
    ),
)
def rule_event_refs(spark, d):
    s = fx.segments(spark, d)
    who = F.array(F.lit("c0"), (F.col("ord") % 9).cast("string"))
    ev = s.select("work_id", F.col("segment_id").alias("event_id"), who.alias("participants"))
    ch = works(spark, d).select("work_id", F.explode(F.array(*[F.lit(x) for x in ("c0", "0", "1", "2", "3", "4", "6", "7", "8")])).alias("character_id"))
    sp = fx.visuals(spark, d).select("work_id", F.col("segment_id").alias("event_id"), "source_id", "start_us", "end_us")
    return ru.rule_event_refs(ev, ch, sp, fx.sources(spark, d)).select(*TWO)


@query(
    "rule_references",
    sql(
        USED
        + """, b AS (SELECT DISTINCT work_id, beat_id FROM segments WHERE ord % 2 = 1),
     f AS (SELECT beat_id AS entity_id, 'BEAT_UNKNOWN_EVENT' AS rule_id FROM b WHERE (work_id, beat_id) NOT IN (SELECT work_id, beat_id FROM segments WHERE ord % 4 = 1) UNION ALL SELECT beat_id, 'BEAT_UNKNOWN_HIGHLIGHT' FROM b WHERE (work_id, beat_id) NOT IN (SELECT work_id, beat_id FROM segments WHERE ord % 3 = 0)
      UNION ALL SELECT segment_id, 'STORYBOARD_UNKNOWN_BEAT' FROM segments WHERE (work_id, beat_id) NOT IN (SELECT work_id, beat_id FROM b) UNION ALL SELECT segment_id, 'UNKNOWN_HIGHLIGHT' FROM segments WHERE mode = 'original' AND (work_id, beat_id) NOT IN (SELECT work_id, beat_id FROM segments WHERE ord % 3 = 0)
      UNION ALL SELECT segment_id, 'UNKNOWN_SOURCE' FROM used WHERE CAST(source_id AS BIGINT) >= 45) SELECT * FROM f""",
        "segments", "visuals",
    ),
)
def rule_references(spark, d):
    s = fx.segments(spark, d).withColumn("highlight_id", F.when(F.col("mode") == "original", F.concat(F.lit("h"), "beat_id")))
    beats = s.where("ord % 2 = 1").select("work_id", "beat_id").distinct().withColumn("event_ids", F.array(F.concat(F.lit("e"), "beat_id"))).withColumn("highlight_ids", F.array(F.concat(F.lit("h"), "beat_id")))
    ev = s.where("ord % 4 = 1").select("work_id", F.concat(F.lit("e"), "beat_id").alias("event_id"))
    hl = s.where("ord % 3 = 0").select("work_id", F.concat(F.lit("h"), "beat_id").alias("highlight_id"))
    src = fx.sources(spark, d).where("ord < 45").select("source_id")
    return ru.rule_references(beats, ev, hl, s, fx.visuals(spark, d), src).select(*TWO)


@query(
    "rule_rights",
    sql(
        """w AS (SELECT CAST(c_custkey AS VARCHAR) AS work_id, c_mktsegment, c_nationkey FROM customer) SELECT work_id AS entity_id, 'RIGHTS_NOT_CONFIRMED' AS rule_id FROM w WHERE c_mktsegment = 'BUILDING' AND c_nationkey % 3 = 0
     UNION ALL SELECT segment_id, 'HOOK_REUSE_DISABLED' FROM segments JOIN w USING (work_id) WHERE c_nationkey % 4 = 0 AND allow_reuse""",
        "segments",
    ),
)
def rule_rights(spark, d):
    w = fx.table(spark, d, "customer").select(
        F.col("c_custkey").cast("string").alias("work_id"), F.when(F.col("c_mktsegment") == "BUILDING", "publish").otherwise("draft").alias("publish_mode"), (F.col("c_nationkey") % 3 != 0).alias("rights_confirmed"), (F.col("c_nationkey") % 4 != 0).alias("allow_hook_reuse")
    )
    return ru.rule_rights(w, fx.segments(spark, d)).select(*TWO)


@query(
    "rule_voice",
    sql(
        NOMINAL
        + """, v AS (SELECT *, CASE WHEN ord % 10 = 3 THEN '' ELSE text END AS tx, ord % 7 <> 2 AS au FROM nominal WHERE mode = 'voiceover')
     SELECT segment_id AS entity_id, 'EMPTY_SEGMENT_TEXT' AS rule_id FROM v WHERE tx = '' UNION ALL SELECT segment_id, 'MISSING_TTS_AUDIO' FROM v WHERE NOT au UNION ALL SELECT segment_id, 'INVALID_TTS_DURATION' FROM v WHERE au AND coalesce(voice_us, 0) <= 0
     UNION ALL SELECT segment_id, 'VISUAL_SHORTER_THAN_TTS' FROM v WHERE voice_us > 0 AND visual_us + 1000 < voice_us""",
        "segments", "visuals",
    ),
)
def rule_voice(spark, d):
    s = fx.segments(spark, d).withColumn("text", F.when(F.col("ord") % 10 == 3, "").otherwise(F.col("text"))).withColumn("has_audio", F.col("ord") % 7 != 2)
    return ru.rule_voice(s, fx.visuals(spark, d)).select(*TWO)


@query(
    "rule_original_captions",
    sql(
        WORDS
        + """, o AS (SELECT s.work_id, s.segment_id, s.ord, count(v.ord) AS nv FROM segments s LEFT JOIN visuals v ON v.segment_id = s.segment_id WHERE mode = 'original' GROUP BY 1, 2, 3),
     p AS (SELECT v.segment_id, v.ord, v.source_id, v.start_us AS v0, v.end_us AS v1, c.cue_id, c.ord AS co FROM visuals v JOIN o ON o.segment_id = v.segment_id JOIN cues c ON c.source_id = v.source_id AND c.start_us < v.end_us AND v.start_us < c.end_us WHERE c.start_us < v.start_us - 1000 OR c.end_us > v.end_us + 1000),
     g AS (SELECT DISTINCT p.segment_id, p.ord, p.cue_id FROM p JOIN words w ON w.cue_id = p.cue_id AND co % 2 = 0 AND w.start_us >= v0 - 1000 AND w.end_us <= v1 + 1000)
     SELECT segment_id AS entity_id, 'ORIGINAL_CAPTIONS_UNVERIFIED' AS rule_id, '' AS evidence FROM o WHERE ord % 3 <> 1 UNION ALL SELECT segment_id, 'ORIGINAL_NOT_CONTIGUOUS', '' FROM o WHERE nv <> 1
     UNION ALL SELECT segment_id, 'PARTIAL_ORIGINAL_CAPTION_UNTIMED', cue_id FROM p WHERE (segment_id, ord, cue_id) NOT IN (SELECT * FROM g)""",
        "segments", "visuals", "cues",
    ),
)
def rule_original_captions(spark, d):
    s = fx.segments(spark, d)
    ok = s.select("work_id", "segment_id", (F.col("ord") % 3 == 1).alias("cues_verified"))
    return ru.rule_original_captions(s, fx.visuals(spark, d), fx.cues(spark, d), words(spark, d), ok).select("entity_id", "rule_id", "evidence")


@query(
    "rule_dialogue_boundary",
    sql(
        """f AS (SELECT v.segment_id, arg_min(v.source_id, v.ord) AS source_id, arg_min(v.start_us, v.ord) AS a, arg_min(v.end_us, v.ord) AS b, s.ord % 2 = 0 AS talk FROM visuals v JOIN segments s ON s.segment_id = v.segment_id WHERE mode = 'original' GROUP BY v.segment_id, s.ord),
     q AS (SELECT f.segment_id, coalesce(min(abs(c.start_us - a)) <= 450000, false) AS ein, coalesce(min(abs(c.end_us - b)) <= 450000, false) AS eout,
      coalesce(bool_or(c.start_us + 20000 < a AND a < c.end_us - 20000), false) AS cin, coalesce(bool_or(c.start_us + 20000 < b AND b < c.end_us - 20000), false) AS cout FROM f LEFT JOIN cues c ON c.source_id = f.source_id GROUP BY 1)
     SELECT f.segment_id AS entity_id, concat_ws(',', CASE WHEN cin OR (talk AND NOT ein) THEN 'entry' END, CASE WHEN cout OR (talk AND NOT eout) THEN 'exit' END) AS evidence FROM f JOIN q USING (segment_id) WHERE cin OR cout OR (talk AND NOT (ein AND eout))""",
        "segments", "visuals", "cues",
    ),
)
def rule_dialogue_boundary(spark, d):
    s = fx.segments(spark, d).withColumn("audio_owner", F.when(F.col("ord") % 2 == 0, "original_dialogue").otherwise("ambience"))
    return ru.rule_dialogue_boundary(s, fx.visuals(spark, d), fx.cues(spark, d)).select("entity_id", "evidence")


@query(
    "rule_hook",
    sql(
        NOMINAL + ", " + USED + """, h AS (SELECT v.work_id, 'h' || v.segment_id AS hid, v.source_id, v.start_us AS a, v.end_us AS b, v.segment_id AS sid FROM visuals v WHERE v.ord = 1),
     plan AS (SELECT work_id, 'h' || arg_min(segment_id, (CASE WHEN ord % 4 = 2 THEN 0 ELSE 1 END, ord)) AS hook FROM segments GROUP BY 1),
     n AS (SELECT *, out_end_us - dur_us AS t_at, CASE WHEN ord % 3 = 0 THEN (SELECT hook FROM plan p WHERE p.work_id = nominal.work_id) ELSE 'h' || segment_id END AS decl FROM nominal),
     u AS (SELECT x.work_id, x.segment_id, h.hid, min(x.local_us + greatest(x.start_us, a) - x.start_us) AS off FROM used x JOIN h ON h.work_id = x.work_id AND h.source_id = x.source_id AND a < x.start_us + x.used_us AND x.start_us < b GROUP BY 1, 2, 3),
     j AS (SELECT u.*, n.ord, n.t_at, n.decl, p.hook FROM u JOIN n ON n.segment_id = u.segment_id JOIN plan p ON p.work_id = u.work_id),
     st AS (SELECT work_id, arg_min(t_at + off, ord) AS hook_us FROM j WHERE hid = hook GROUP BY 1)
     SELECT segment_id AS entity_id, 'HOOK_MISMATCH' AS rule_id FROM j WHERE ord = 1 AND hid = decl AND hid <> hook
     UNION ALL SELECT n.segment_id, 'HOOK_REFERENCE_WITHOUT_SOURCE_EVIDENCE' FROM n JOIN plan p ON p.work_id = n.work_id AND n.decl = p.hook WHERE p.hook IN (SELECT hid FROM h) AND NOT EXISTS (SELECT 1 FROM j WHERE j.segment_id = n.segment_id AND j.hid = p.hook)
     UNION ALL SELECT p.work_id, 'HOOK_NOT_USED' FROM plan p LEFT JOIN st USING (work_id) WHERE hook_us IS NULL UNION ALL SELECT work_id, 'HOOK_TOO_LATE' FROM st WHERE hook_us > 6000000""",
        "segments", "visuals",
    ),
)
def rule_hook(spark, d):
    s, v = stored_cut(spark, d)
    h = lying(written(_highlights(s.stored, v.stored), "highlights"), ["work_id"])
    counted = s.stored, v.stored, h.stored, _spans(v.stored)
    events, know = _events(s), _known(s)
    pick = F.struct(F.when(F.col("ord") % 4 == 2, 0).otherwise(1), "ord")
    plan = s.stored.groupBy("work_id").agg(F.concat(F.lit("h"), F.min_by("segment_id", pick)).alias("hook_id"))
    plan = lying(written(plan, "hooks"), ["work_id"])  # one choice for all rules, also where segments share a place
    s = s.join(plan, "work_id").withColumn("highlight_id", F.when(F.col("ord") % 3 == 0, F.col("hook_id")).otherwise(F.concat(F.lit("h"), "segment_id"))).drop("hook_id").withColumn("hook_preposed", F.lit(False))
    return ru.rule_hook(s, v, h, plan, events, _spans(v), know, counted=counted).select(*TWO)


@query(
    "rule_probe",
    """WITH f AS (SELECT *, c_custkey % 13 AS m, CASE c_custkey % 13 WHEN 5 THEN 29.5 ELSE 30 END AS r FROM customer), x AS (SELECT CAST(c_custkey AS VARCHAR) AS w, m, r, c_nationkey AS n FROM f)
     SELECT w AS entity_id, ['MISSING_OUTPUT_REFERENCE','MISSING_FINAL_VIDEO','RENDER_ARTIFACT_MISMATCH','MISSING_VIDEO_STREAM','OUTPUT_DIMENSION_MISMATCH','OUTPUT_FPS_MISMATCH','OUTPUT_VIDEO_CODEC_MISMATCH','MISSING_AUDIO_STREAM','OUTPUT_AUDIO_CODEC_MISMATCH','OUTPUT_AUDIO_FORMAT_MISMATCH','OUTPUT_DURATION_MISMATCH'][m + 1] AS rule_id FROM x WHERE m < 11""",
)
def rule_probe(spark, d):
    c = fx.table(spark, d, "customer")
    m = F.col("c_custkey") % 13
    one = lambda i, a, b: F.when(m == i, a).otherwise(b)
    w = F.col("c_custkey").cast("string").alias("work_id")
    f = c.select(
        w, (m != 0).alias("has_reference"), one(1, 0, 100).alias("file_bytes"), one(2, "bad", "ok").alias("sha256"), (m != 3).alias("has_video"), one(4, 720, 1080).alias("width"), F.lit(1920).alias("height"),
        one(5, 59, 60).cast("bigint").alias("rate_num"), F.lit(2).cast("bigint").alias("rate_den"), one(6, "vp9", "h264").alias("video_codec"), (m != 7).alias("has_audio"), one(8, "mp3", "aac").alias("audio_codec"),
        F.lit(48_000).alias("sample_rate"), one(9, 1, 2).alias("channels"), one(10, 62_000_000, 60_500_000).cast("bigint").alias("duration_us"),
    )
    e = c.select(w, F.lit(1080).alias("width"), F.lit(1920).alias("height"), F.lit(30).cast("bigint").alias("fps_num"), F.lit(1).cast("bigint").alias("fps_den"), F.when(F.col("c_nationkey") % 2 == 0, "libx264").otherwise("h264_nvenc").alias("video_encoder"),
                 F.lit("libfdk_aac").alias("audio_encoder"), F.lit(60_000_000).cast("bigint").alias("duration_us"), F.lit("ok").alias("sha256"))
    return ru.rule_probe(f, e).select(*TWO)


@query(
    "rule_realized",
    sql(
        REALIZED
        + """, bad AS (SELECT DISTINCT work_id FROM rt WHERE fc <= 0 OR abs(fc*1000000 - dur_us*30) > 1000000 OR abs(end_frame*1000000 - out_end_us*30) > 1000000), t AS (SELECT work_id, max(end_frame) AS f, max(out_end_us) AS n FROM rt GROUP BY 1)
     SELECT work_id AS entity_id, 'INVALID_REALIZED_TIMELINE' AS rule_id FROM bad UNION ALL SELECT work_id, 'NOMINAL_FRAME_QUANTIZATION' FROM t WHERE abs(f*1000000 - n*30) > 1000000""",
        "segments", "visuals",
    ),
)
def rule_realized(spark, d):
    clock, bad = tl.realized_timeline(fx.segments(spark, d), fx.visuals(spark, d), facts(spark, d), 30, 1)
    return ru.rule_realized(clock, bad, 30, 1).select(*TWO)


@query(
    "rule_subtitles",
    sql(
        """e AS (SELECT source_id AS w, ord + 1 AS pos, start_us AS a, end_us AS b, trim(text) AS t FROM cues), k AS (SELECT w, max(b) AS dur, CAST(w AS BIGINT) % 7 <> 0 AS hf FROM e GROUP BY 1),
     f AS (SELECT w, pos, CASE WHEN CAST(w AS BIGINT) % 5 = 1 AND pos = 2 THEN a + 5000 ELSE a END AS a, b, t FROM e WHERE NOT (CAST(w AS BIGINT) % 11 = 3 AND pos = 1)),
     m AS (SELECT w FROM e LEFT JOIN f USING (w, pos) JOIN k USING (w) WHERE hf AND (f.a IS NULL OR abs(f.a - e.a) > 2000)), l AS (SELECT *, lag(a) OVER (PARTITION BY w ORDER BY pos) AS pa, lag(b) OVER (PARTITION BY w ORDER BY pos) AS pb FROM f)
     SELECT DISTINCT w AS entity_id, 'INVALID_SUBTITLE_FILE' AS rule_id FROM (SELECT w FROM m UNION ALL SELECT w FROM l JOIN k USING (w) WHERE a < pa OR b > dur + 50000 OR a < pb - 1000)
     UNION ALL SELECT w, 'MISSING_SUBTITLE_FILE' FROM k WHERE NOT hf UNION ALL SELECT w || '#' || pos, 'SUBTITLE_READABILITY_RISK' FROM f WHERE b - a < 350000
     UNION ALL SELECT w || '#' || pos, 'SUBTITLE_READABILITY_RISK' FROM f WHERE len(string_split(t, chr(10))) > 2 OR list_max(list_transform(string_split(t, chr(10)), lambda s: length(s))) > 150
     UNION ALL SELECT w, 'SUBTITLE_BURN_UNVERIFIED' FROM k WHERE CAST(w AS BIGINT) % 2 = 0""",
        "cues",
    ),
)
def rule_subtitles(spark, d):
    c = fx.cues(spark, d).select(F.col("source_id").alias("work_id"), (F.col("ord") + 1).alias("pos"), "start_us", "end_us", F.trim("text").alias("text"))
    i = F.col("work_id").cast("bigint")
    f = c.where(~((i % 11 == 3) & (F.col("pos") == 1))).withColumn("start_us", F.when((i % 5 == 1) & (F.col("pos") == 2), F.col("start_us") + 5000).otherwise(F.col("start_us")))
    w = c.groupBy("work_id").agg(F.max("end_us").alias("duration_us")).select("work_id", "duration_us", (i % 7 != 0).alias("has_file"), (i % 2 == 0).alias("burn_required"), F.lit(False).alias("burn_applied"), F.lit(0).alias("n_estimated"))
    return ru.rule_subtitles(f, c, w, 2, 150).select(*TWO)


@query(
    "rule_review",
    sql(
        """w AS (SELECT source_id, max(end_us) AS dur FROM cues GROUP BY 1) SELECT source_id AS entity_id, 'AUDIO_REVIEW_NOT_VERIFIED' AS rule_id FROM w UNION ALL SELECT source_id, 'VISUAL_REVIEW_NOT_VERIFIED' FROM w WHERE CAST(source_id AS BIGINT) % 3 = 0""",
        "cues",
    ),
)
def rule_review(spark, d):
    c = fx.cues(spark, d).select(F.col("source_id").alias("work_id"), F.col("cue_id").alias("range_id"), "start_us", "end_us", F.lit("visual").alias("kind"))
    w = c.groupBy("work_id").agg(F.max("end_us").alias("duration_us"))
    lost = (F.col("work_id").cast("bigint") % 3 == 0) & (F.col("start_us") == 0)
    return ru.rule_review(c.where(~lost), w).select(*TWO)


@query(
    "rule_signal_share",
    sql(
        """l AS (SELECT *, CASE WHEN value < 40 THEN 1 ELSE 0 END AS low FROM signals), p AS (SELECT *, lag(low) OVER (PARTITION BY source_id ORDER BY t_us, row_id) AS pl FROM l),
     r AS (SELECT *, sum(CASE WHEN pl IS NULL OR pl <> low THEN 1 ELSE 0 END) OVER (PARTITION BY source_id ORDER BY t_us, row_id) AS run FROM p),
     g AS (SELECT source_id, sum(b - a) AS s FROM (SELECT source_id, min(t_us) AS a, max(t_us) AS b FROM r WHERE low = 1 GROUP BY source_id, run HAVING max(t_us) - min(t_us) >= 3600000000) GROUP BY 1),
     t AS (SELECT source_id, max(t_us) - min(t_us) AS d FROM signals GROUP BY 1)
     SELECT t.source_id AS entity_id, 'EXCESSIVE_BLACK_FRAMES' AS rule_id FROM t JOIN g USING (source_id) WHERE round(s/d, 6) > 0.3 UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'BLACK_SCAN_UNAVAILABLE' FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events)""",
        "signals",
    ),
)
def rule_signal_share(spark, d):
    s = fx.signals(spark, d)
    t = s.groupBy("source_id").agg((F.max("t_us") - F.min("t_us")).alias("duration_us"))
    r = sg.run_ratio(sg.runs_below(s, ["source_id"], 40.0, 3_600_000_000, ["t_us", "row_id"]), t, ["source_id"]).withColumnRenamed("source_id", "work_id")
    return ru.rule_signal_share(r, fx.table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("work_id")), "black", 0.3).select(*TWO)


def _proposals(spark, d):
    u = fx.units(spark, d)
    i = F.col("unit_id").cast("bigint")
    units = u.select("unit_id", "source_id", "start_us", "end_us", F.sha2("unit_id", 256).alias("revision"))
    p = u.select(
        F.concat(F.lit("p"), "unit_id").alias("proposal_id"), F.concat(F.lit("c"), "unit_id").alias("candidate_id"), F.when(i % 10 == 1, "old").otherwise("r1").alias("candidate_revision"), "source_id",
        F.when(i % 10 == 2, "x").otherwise("s").alias("source_sha256"), F.col("start_us"), (F.col("start_us") + 25_000_000).alias("end_us"), F.when(i % 10 != 3, F.col("start_us") - 1).alias("ctx_start_us"),
        (F.col("start_us") + 26_000_000).alias("ctx_end_us"), F.when(i % 10 == 4, F.lit(None)).otherwise(i % 10 != 5).alias("timebase_ok"),
    )
    base = u.select(F.concat(F.lit("p"), "unit_id").alias("proposal_id"), i.alias("k"))
    refs = base.select("proposal_id", F.lit(1).cast("bigint").alias("ord"), F.col("k").cast("string").alias("unit_id")).unionByName(base.select("proposal_id", F.lit(2).cast("bigint").alias("ord"), (F.col("k") + F.when(F.col("k") % 2 == 0, 20).otherwise(3)).cast("string").alias("unit_id")))
    refs = refs.withColumn("unit_revision", F.sha2("unit_id", 256))
    src = u.groupBy("source_id").agg(F.max("end_us").alias("duration_us")).withColumn("sha256", F.lit("s"))
    cand = u.select(F.concat(F.lit("c"), "unit_id").alias("candidate_id"), F.lit("r1").alias("revision"), "source_id")
    return p, units, refs, src, cand


CHECKS = """b AS (SELECT CAST(unit_id AS BIGINT) AS i, source_id, start_us, start_us + 25000000 AS p1 FROM units), m AS (SELECT source_id, max(end_us) AS dur FROM units GROUP BY 1),
 r AS (SELECT i, 1 AS ord, i AS k FROM b UNION ALL SELECT i, 2, i + CASE WHEN i % 2 = 0 THEN 20 ELSE 3 END FROM b),
 v AS (SELECT r.*, b.start_us AS p0, b.p1, u.start_us AS u0, u.end_us AS u1, coalesce(u.source_id = b.source_id, false) AS ok FROM r JOIN b USING (i) LEFT JOIN units u ON u.unit_id = CAST(r.k AS VARCHAR)),
 o AS (SELECT i, bool_or(ok AND p > u0) AS bad FROM (SELECT *, lag(u0) OVER (PARTITION BY i ORDER BY ord) AS p FROM v WHERE ok) GROUP BY 1),
 c0 AS (SELECT i, p0, p1, greatest(u0, p0) AS a, least(u1, p1) AS z FROM v WHERE ok AND greatest(u0, p0) < least(u1, p1)),
 c1 AS (SELECT *, max(z) OVER (PARTITION BY i ORDER BY a, z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM c0), c2 AS (SELECT i, bool_or(a > coalesce(reach, p0)) OR max(z) < max(p1) AS hole FROM c1 GROUP BY 1),
 chk AS (SELECT i, 'source_identity' AS "check", CASE WHEN i % 10 = 2 THEN 'reject' ELSE 'accept' END AS state FROM b UNION ALL SELECT i, 'candidate_revision', CASE WHEN i % 10 = 1 THEN 'reject' ELSE 'accept' END FROM b
  UNION ALL SELECT i, 'source_range', CASE WHEN p1 <= dur THEN 'accept' ELSE 'reject' END FROM b JOIN m USING (source_id) UNION ALL SELECT i, 'timebase', CASE i % 10 WHEN 4 THEN 'unknown' WHEN 5 THEN 'reject' ELSE 'accept' END FROM b
  UNION ALL SELECT i, 'context', CASE WHEN i % 10 = 3 THEN 'unknown' ELSE 'accept' END FROM b UNION ALL SELECT i, 'unit:' || k, CASE WHEN ok THEN 'accept' ELSE 'reject' END FROM v UNION ALL SELECT i, 'unique_units', 'accept' FROM b
  UNION ALL SELECT i, 'unit_order', CASE WHEN bad THEN 'reject' ELSE 'accept' END FROM o UNION ALL SELECT b.i, 'coverage', CASE WHEN coalesce(hole, true) THEN 'unknown' ELSE 'accept' END FROM b LEFT JOIN c2 USING (i))"""

query("boundary_checks", sql(CHECKS + """ SELECT 'p' || i AS proposal_id, "check", state FROM chk""", "units"))(lambda s, d: ru.boundary_checks(*_proposals(s, d)))
query(
    "boundary_state",
    sql(CHECKS + " SELECT 'p' || i AS proposal_id, CASE WHEN bool_or(state = 'reject') THEN 'reject' WHEN bool_or(state = 'unknown') THEN 'unknown' ELSE 'accept' END AS state FROM chk GROUP BY i", "units"),
)(lambda s, d: ru.tri_state(ru.boundary_checks(*_proposals(s, d)), ["proposal_id"]))


@query(
    "node_checks",
    sql(
        """q AS (SELECT CAST(unit_id AS BIGINT) AS i, unnest(['n0', 'n1', 'n2']) AS node, unnest([0, 1, 2]) AS j FROM units), o AS (SELECT i, node, CASE (i + j) % 3 WHEN 0 THEN 'accept' WHEN 1 THEN 'reject' ELSE 'unknown' END AS st FROM q WHERE (i*7 + j) % 4 <> 0 AND (i + j) % 5 <> 0)
     SELECT 'p' || q.i AS proposal_id, 'semantic:' || q.node AS "check", coalesce(st, 'unknown') AS state FROM q LEFT JOIN o USING (i, node)""",
        "units",
    ),
)
def node_checks(spark, d):
    p = _proposals(spark, d)[0]
    i = F.substring("proposal_id", 2, 20).cast("bigint")
    r = p.select("proposal_id", "start_us", i.alias("i"), F.posexplode(F.array(F.lit("n0"), F.lit("n1"), F.lit("n2"))).alias("j", "node"))
    k = (F.col("i") + F.col("j")) % 3
    o = r.where((F.col("i") * 7 + F.col("j")) % 4 != 0).select("proposal_id", "node", F.when(k == 0, "accept").when(k == 1, "reject").otherwise("unknown").alias("state"), F.lit(True).alias("has_evidence"),
        (F.col("start_us") - F.when((F.col("i") + F.col("j")) % 5 == 0, 5).otherwise(0)).alias("obs_start_us"), (F.col("start_us") + 9).alias("obs_end_us"))
    return ru.node_checks(r.select("proposal_id", "node"), o, p)


@query(
    "claim_verdicts",
    """WITH c AS (SELECT doc_id AS i, ['action', 'speaker', 'tone', 'motivation', 'identity'][1 + doc_id % 5] AS ty, CASE WHEN doc_id % 2 = 0 THEN 'accept' ELSE 'reject' END AS j FROM documents),
     x AS (SELECT *, CASE WHEN ty = 'tone' THEN ['audio'] WHEN ty = 'speaker' THEN ['video', 'audio'] ELSE ['video'] END AS need, CASE WHEN i % 3 = 0 THEN ['video'] ELSE ['video', 'audio'] END AS have, i % 4 = 0 AS gap, i % 7 <> 0 AS node_ok, CASE WHEN i % 6 = 0 THEN 'contradict' ELSE 'support' END AS rel FROM c)
     SELECT i AS claim_id, CASE WHEN r = '' THEN j ELSE 'unknown' END AS verdict, r AS reasons FROM (SELECT *, concat_ws(';', CASE WHEN list_contains(need, 'audio') AND NOT list_contains(have, 'audio') THEN 'missing_modalities' END, CASE WHEN gap THEN 'raw_coverage_gap' END,
      CASE WHEN ty = 'action' AND i % 8 = 0 THEN 'continuous_video_not_observed' END, CASE WHEN gap AND ty IN ('action', 'speaker') THEN 'independent_video_coverage_gap' END, CASE WHEN ty = 'motivation' THEN 'internal_motivation_not_directly_observable' END,
      CASE WHEN list_contains(need, 'audio') THEN 'required_modality_not_observed_by_reviewer' END, CASE WHEN NOT node_ok THEN 'required_claim_nodes_not_covered' END,
      CASE WHEN j = 'accept' AND rel <> 'support' THEN 'accept_without_consistent_located_support' END, CASE WHEN j = 'reject' AND rel <> 'contradict' THEN 'reject_without_located_contradiction' END) AS r FROM x)""",
)
def claim_verdicts(spark, d):
    i = F.col("doc_id")
    t = fx.table(spark, d, "documents")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("action", "speaker", "tone", "motivation", "identity")]), (i % 5 + 1).cast("int"))
    c = t.select(i.alias("claim_id"), kind.alias("claim_type"), F.array().cast("array<string>").alias("extra_modalities"), F.array(F.lit("n")).alias("required_nodes"), F.when(i % 2 == 0, "accept").otherwise("reject").alias("judgment"))
    a = t.select(i.alias("claim_id"), F.lit("video").alias("modality"), F.when(i % 8 == 0, "video_frame").otherwise("video_clip").alias("kind")).unionByName(t.where(i % 3 != 0).select(i.alias("claim_id"), F.lit("audio").alias("modality"), F.lit("audio_pcm").alias("kind")))
    g = t.where(i % 4 == 0).select(i.alias("claim_id"), F.lit("video").alias("modality"))
    o = t.select(i.alias("claim_id"), F.when(i % 7 != 0, "n").otherwise("m").alias("node"), F.lit("video").alias("modality"), F.when(i % 6 == 0, "contradict").otherwise("support").alias("relation"))
    return ru.claim_verdicts(c, a, g, o)


@query(
    "rule_story_integrity",
    """SELECT CAST(o_orderkey AS VARCHAR) AS entity_id, 'EVENT_WITHOUT_EVIDENCE' AS rule_id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) UNION ALL SELECT CAST(l_orderkey + 7 AS VARCHAR), 'KNOWLEDGE_UNKNOWN_EVENT' FROM lineitem WHERE l_orderkey + 7 NOT IN (SELECT o_orderkey FROM orders)""",
)
def rule_story_integrity(spark, d):
    one = F.lit("w").alias("work_id")
    e = orders(spark, d).select(one, F.col("o_orderkey").cast("string").alias("event_id"))
    li = fx.table(spark, d, "lineitem")
    return ru.rule_story_integrity(e, li.select(one, F.col("l_orderkey").cast("string").alias("event_id")), li.select(one, (F.col("l_orderkey") + 7).cast("string").alias("event_id"))).select(*TWO)


@query(
    "benchmark_readiness",
    """WITH c AS (SELECT o_orderkey AS i, CASE WHEN o_orderkey % 9 <> 0 THEN 'm' || o_orderkey % 3 END AS mat, CASE WHEN o_orderkey % 5 <> 0 THEN 'm' || (o_orderkey % 3 + CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END) END AS g, o_orderkey % 4 AS nf FROM orders),
     k AS (SELECT l_orderkey AS i, count(*) AS n, bool_or(l_quantity > 45) AS bad FROM lineitem GROUP BY 1), r AS (SELECT l_orderkey AS i, count(DISTINCT l_suppkey % 3) AS n FROM lineitem GROUP BY 1),
     x AS (SELECT c.i, concat_ws(',', CASE WHEN g IS NOT NULL AND (nf = 0 OR k.n IS NULL) THEN 'incomplete_gold_annotations' END, CASE WHEN g IS NOT NULL AND bad THEN 'invalid_highlight_boundary' END, CASE WHEN g IS NULL THEN 'missing_human_gold' END, CASE WHEN mat IS NULL THEN 'missing_source_material' END,
      CASE WHEN g IS NOT NULL AND mat <> g THEN 'source_gold_fingerprint_mismatch' END, CASE WHEN g IS NOT NULL AND coalesce(r.n, 0) < 2 THEN 'two_named_reviewers_required' END) AS s FROM c LEFT JOIN k USING (i) LEFT JOIN r USING (i))
     SELECT CAST(i AS VARCHAR) AS case_id, CASE WHEN s = '' THEN 'READY_FOR_REVIEW' ELSE 'NOT_READY' END AS status, s AS issues FROM x""",
)
def benchmark_readiness(spark, d):
    i = F.col("o_orderkey")
    o, li = orders(spark, d), fx.table(spark, d, "lineitem")
    cid = i.cast("string").alias("case_id")
    cases = o.select(cid, F.when(i % 9 != 0, F.concat(F.lit("m"), i % 3)).alias("material_sha"))
    gold = o.where(i % 5 != 0).select(cid, F.concat(F.lit("m"), i % 3 + F.when(i % 7 == 0, 1).otherwise(0)).alias("source_sha256"), F.lit(45).alias("duration_us"), (i % 4).alias("n_facts"), F.lit(True).alias("has_reveal"))
    lid = F.col("l_orderkey").cast("string").alias("case_id")
    rev = li.select(lid, (F.col("l_suppkey") % 3).cast("string").alias("name"))
    keep = li.select(lid, F.lit(0).alias("start_us"), F.col("l_quantity").cast("int").alias("end_us"), F.lit("why").alias("reason"))
    return ru.readiness(cases, gold, rev, keep)


@query(
    "boundary_adoption",
    sql(
        NOMINAL + """, p AS (SELECT v.work_id, 'h' || v.segment_id AS hid, v.source_id, v.start_us AS a0, v.end_us AS b0, v.start_us + 1000000 AS a, v.end_us + 2500000 AS b, s.ord % 10 = 4 AS prot, v.segment_id AS sid FROM visuals v JOIN segments s ON s.segment_id = v.segment_id WHERE v.ord = 1),
     nw AS (SELECT DISTINCT p.work_id, hid, v.segment_id AS ev FROM p JOIN visuals v ON v.work_id = p.work_id AND v.source_id = p.source_id AND v.start_us < b AND a < v.end_us), od AS (SELECT DISTINCT p.work_id, hid, v.segment_id AS ev FROM p JOIN visuals v ON v.work_id = p.work_id AND v.source_id = p.source_id AND v.start_us < b0 AND a0 < v.end_us),
     n AS (SELECT nw.*, od.ev IS NULL AS isnew FROM nw LEFT JOIN od USING (work_id, hid, ev)), dc AS (SELECT work_id, hid, sid AS ev, false AS newly FROM p),
     j AS (SELECT hid, isnew, newly FROM n FULL JOIN dc USING (work_id, hid, ev)),
     s AS (SELECT m.segment_id, m.out_end_us - m.dur_us AS t_at, m.mode, p.* FROM nominal m JOIN p ON p.work_id = m.work_id AND p.hid = 'h' || m.segment_id), vv AS (SELECT segment_id, count(*) AS nv, min(start_us) AS v0, max(end_us) AS v1 FROM visuals GROUP BY 1)
     SELECT hid AS entity_id, 'EVENT_RANGE_RECONCILIATION_REQUIRED' AS rule_id FROM j WHERE isnew IS NULL OR newly IS NULL UNION ALL SELECT hid, 'REVEAL_RANGE_RECONCILIATION_REQUIRED' FROM j WHERE isnew <> newly UNION ALL SELECT hid, 'PROTECTED_HIGHLIGHT' FROM p WHERE prot
     UNION ALL SELECT segment_id, 'OUTPUT_REVEAL_POSITION_CONFLICT' FROM s WHERE t_at < 5000000 OR t_at > 60000000 UNION ALL SELECT s.segment_id, 'MANUAL_ORIGINAL_RANGE_CONFLICT' FROM s LEFT JOIN vv ON vv.segment_id = s.segment_id WHERE mode = 'original' AND (coalesce(nv, 0) <> 1 OR v0 <> a0 OR v1 <> b0)""",
        "segments", "visuals",
    ),
)
def boundary_adoption(spark, d):
    s, v = stored_cut(spark, d)
    hid = F.concat(F.lit("h"), "segment_id").alias("highlight_id")
    p = v.stored.where("ord = 1").join(s.stored.select("segment_id", F.col("ord").alias("so")), "segment_id").select(
        "work_id", hid, "source_id", F.col("start_us").alias("old_start_us"), F.col("end_us").alias("old_end_us"), (F.col("start_us") + 1_000_000).alias("start_us"), (F.col("end_us") + 2_500_000).alias("end_us"),
        F.lit(5_000_000).alias("min_out_us"), F.lit(60_000_000).alias("max_out_us"), (F.col("so") % 10 == 4).alias("protected"),
    )
    p, sp = lying(written(p, "proposals"), ["work_id"]), _spans(v)
    dec = v.where("ord = 1").select("work_id", hid, F.col("segment_id").alias("event_id"), F.lit(False).alias("newly"))
    return ru.boundary_adoption(p, sp.select("work_id", "event_id").distinct(), sp, dec, s.withColumn("highlight_id", hid), v, counted=(p.stored, _spans(v.stored), s.stored)).select(*TWO)


@query(
    "evidence_cards",
    sql(
        """p AS (SELECT work_id, max(source_id) AS ps, 0 AS a, 40000000 AS b FROM visuals GROUP BY 1), dc AS (SELECT work_id, segment_id AS card, segment_id AS h FROM segments WHERE ord % 5 <> 0),
     ca AS (SELECT v.work_id, v.segment_id AS card, CASE WHEN s.ord % 6 = 1 THEN 'x' ELSE v.segment_id END AS h, s.ord, v.ord AS vo, v.start_us AS a, v.end_us AS b, max(v.source_id) OVER (PARTITION BY v.work_id) AS src0, CASE WHEN s.ord % 4 = 2 THEN 'zz' END AS alt FROM visuals v JOIN segments s ON s.segment_id = v.segment_id),
     hv AS (SELECT DISTINCT work_id, card, h, coalesce(alt, src0) AS cs FROM ca), j AS (SELECT work_id, card, dc.h AS dh, hv.h AS ch, cs FROM dc FULL JOIN hv USING (work_id, card)),
     f AS (SELECT j.work_id, card AS entity_id, CASE WHEN dh IS NULL OR ch IS NULL THEN 'CARD_SET_MISMATCH' WHEN dh <> ch THEN 'CARD_HASH_CHANGED' WHEN cs <> ps THEN 'CARD_SOURCE_MISMATCH' END AS rule_id FROM j JOIN p USING (work_id)),
     c AS (SELECT ca.work_id, greatest(ca.a, p.a) AS s, least(ca.b, p.b) AS e, p.a AS p0, p.b AS p1 FROM ca JOIN p USING (work_id) WHERE greatest(ca.a, p.a) < least(ca.b, p.b)),
     d AS (SELECT *, max(e) OVER (PARTITION BY work_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM c), g AS (SELECT work_id, bool_or(s > coalesce(reach, p0)) OR max(e) < max(p1) AS hole FROM d GROUP BY 1)
     SELECT work_id AS proposal_id, entity_id, rule_id FROM f WHERE rule_id IS NOT NULL UNION ALL SELECT p.work_id, 'video', 'VIDEO_COVERAGE_UNKNOWN' FROM p LEFT JOIN g USING (work_id) WHERE coalesce(hole, true)""",
        "segments", "visuals",
    ),
)
def evidence_cards(spark, d):
    s, v = fx.segments(spark, d), fx.visuals(spark, d)
    p = v.groupBy(F.col("work_id").alias("proposal_id")).agg(F.max("source_id").alias("source_id")).withColumn("start_us", F.lit(0).cast("bigint")).withColumn("end_us", F.lit(40_000_000).cast("bigint"))
    dec = s.where("ord % 5 <> 0").select(F.col("work_id").alias("proposal_id"), F.col("segment_id").alias("card_id"), F.col("segment_id").alias("card_sha"))
    c = v.join(s.select("segment_id", F.col("ord").alias("so")), "segment_id").drop("source_id").join(p.select(F.col("proposal_id").alias("work_id"), "source_id"), "work_id")
    c = c.select(F.col("work_id").alias("proposal_id"), F.col("segment_id").alias("card_id"), F.when(F.col("so") % 6 == 1, "x").otherwise(F.col("segment_id")).alias("card_sha"), F.when(F.col("so") % 4 == 2, "zz").otherwise(F.col("source_id")).alias("source_id"), F.lit("video").alias("modality"), "start_us", "end_us")
    return ru.evidence_cards(dec, c, p, ["video"])
