"""Queries of the plan compilers."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanframe import fixtures as fx
from spanframe.catalog.cte import sql
from spanframe.catalog.registry import query
from spanframe.catalog.timeline import PLACED, by_work, he, placed
from spanframe.operators import compile as cp
from spanframe.plans.ordered import lying
from spanframe.plans.rounds import written

TWO = ["entity_id", "rule_id"]


def layers(c):
    o = F.col("ord")
    return c.select(
        "work_id", F.concat(F.lit("L"), "clip_id").alias("layer_id"), F.when(o % 4 == 3, F.lit(None)).otherwise(F.col("clip_id")).alias("anchor_clip_id"), (F.col("gain_db") * 2 + 6).alias("offset_frames"),
        (o * 20).alias("frames"), F.lit(0).alias("source_start_frame"), F.lit(110).alias("source_frames"), F.lit(640).alias("source_width"), F.lit(360).alias("source_height"),
        (o * 2).alias("x"), F.when(o % 5 == 0, 3).otherwise(4).alias("y"), F.when(o % 3 == 0, 1280).otherwise(320).alias("w"), F.when(o % 3 == 0, 720).otherwise(180).alias("h"),
        F.when(o % 6 == 2, 0.0).otherwise(0.5).alias("opacity"), F.when(o == 2, 1).otherwise(o).alias("z"), (o % 2 == 0).alias("allow_upscale"),
    )


def canvas(c):
    return c.select("work_id").distinct().withColumn("width", F.lit(1920)).withColumn("height", F.lit(1080))


LAYERS = (
    PLACED
    + """, ly AS (SELECT work_id, 'L' || clip_id AS layer_id, CASE WHEN ord % 4 = 3 THEN NULL ELSE clip_id END AS anchor, gain_db*2 + 6 AS off, ord*20 AS fr, ord, CASE WHEN ord = 2 THEN 1 ELSE ord END AS z FROM clips),
  tt AS (SELECT work_id, max(out_end_frame) AS total FROM timeline GROUP BY 1),
  lp AS (SELECT ly.*, tt.total, count(*) OVER (PARTITION BY ly.work_id, z) AS nz, CASE WHEN anchor IS NULL THEN 0 ELSE t.out_start_frame END + off AS s FROM ly JOIN tt USING (work_id) LEFT JOIN timeline t ON t.work_id = ly.work_id AND t.clip_id = anchor)"""
)


@query(
    "layer_findings",
    sql(
        LAYERS
        + """ SELECT layer_id AS entity_id, 'OVERLAY_OUTSIDE_BASE' AS rule_id FROM lp WHERE s < 0 OR s + fr > total UNION ALL SELECT layer_id, 'OVERLAY_Z_AMBIGUOUS' FROM lp WHERE nz > 1 UNION ALL SELECT layer_id, 'OVERLAY_EVEN_RECT_REQUIRED' FROM lp WHERE ord % 5 = 0
     UNION ALL SELECT layer_id, 'OVERLAY_SOURCE_TOO_SHORT_NO_FREEZE' FROM lp WHERE fr > 110 UNION ALL SELECT layer_id, 'OVERLAY_UPSCALE_NOT_ALLOWED' FROM lp WHERE ord % 3 = 0 AND ord % 2 <> 0""",
        "clips",
    ),
)
def layer_findings(spark, d):
    t = placed(spark, d)
    return cp.normalize_layers(layers(t), t, canvas(t))[1].select(*TWO)


@query("layer_placement", sql(LAYERS + " SELECT work_id, layer_id, z, s AS start_frame, s + fr AS end_frame FROM lp", "clips"))
def layer_placement(spark, d):
    t = placed(spark, d)
    return cp.normalize_layers(layers(t), t, canvas(t))[0].select("work_id", "layer_id", "z", "start_frame", "end_frame")


@query(
    "rect_checks",
    """WITH r AS (SELECT p_partkey AS i, p_size AS s, p_partkey % 3 AS m FROM part) SELECT CAST(i AS VARCHAR) AS entity_id, 'EVEN_RECT_REQUIRED' AS rule_id FROM r WHERE s % 2 <> 0 UNION ALL SELECT CAST(i AS VARCHAR), 'CROP_OUTSIDE_SOURCE' FROM r WHERE s*20 + 640 > 1280
     UNION ALL SELECT CAST(i AS VARCHAR), 'PLACEMENT_OUTSIDE_CANVAS' FROM r WHERE m = 1 UNION ALL SELECT CAST(i AS VARCHAR), 'ASPECT_DISTORTION' FROM r WHERE m = 2 UNION ALL SELECT CAST(i AS VARCHAR), 'UPSCALE_NOT_ALLOWED' FROM r WHERE m = 1 AND i % 2 = 0""",
)
def rect_checks(spark, d):
    m = F.col("p_partkey") % 3
    r = fx.table(spark, d, "part").select(
        F.lit("w").alias("work_id"), F.col("p_partkey").cast("string").alias("rect_id"), F.lit(1280).alias("src_w"), F.lit(720).alias("src_h"), F.lit(1080).alias("canvas_w"), F.lit(1920).alias("canvas_h"),
        (F.col("p_size") * 20).alias("crop_x"), F.col("p_size").alias("crop_y"), F.lit(640).alias("crop_w"), F.lit(360).alias("crop_h"), F.lit(0).alias("place_x"), F.lit(0).alias("place_y"),
        F.when(m == 1, 1280).otherwise(640).alias("place_w"), F.when(m == 1, 720).when(m == 2, 300).otherwise(360).alias("place_h"), (F.col("p_partkey") % 2 != 0).alias("allow_upscale"),
    )
    return cp.check_rects(r).select(*TWO)


def _sections(spark, d):
    """Sections: the orders of a customer, cut into shots by their lines."""
    s = fx.segments(spark, d)
    sec = s.select("work_id", F.col("segment_id").alias("section_id"), "ord", (F.col("ord") * 40_000_000 + F.col("planned_us") % 7_000_000).alias("start_us"))
    lines = fx.lines(spark, d, "section_id")
    n = lines.groupBy("section_id").agg(F.count(F.lit(1)).alias("n"))
    sec = sec.join(n, "section_id").withColumn("end_us", F.col("start_us") + F.col("n") * 1_234_567)
    li = lines.select("section_id", F.col("ord").alias("k"), (F.col("l_partkey") % 60).cast("string").alias("angle_id"), (F.col("l_suppkey") % 20 == 0).alias("gap"))
    sh = li.join(sec.select("work_id", "section_id", "start_us"), "section_id")
    a = F.col("start_us") + (F.col("k") - 1) * 1_234_567
    sh = sh.select("work_id", "section_id", F.col("k").alias("ord"), "angle_id", (a + F.when(F.col("gap"), 500).otherwise(0)).alias("s0"), (a + 1_234_567).alias("end_us")).withColumnRenamed("s0", "start_us")
    pl = fx.sources(spark, d).where("ord < 50").select("source_id", (-F.col("ord") * 100_000).alias("offset_us"), F.lit(900_000_000).cast("bigint").alias("duration_us"))
    pr = sec.select("work_id", "section_id", (F.col("ord") % 50).cast("string").alias("source_id"), F.lit(-6).alias("gain_db"))
    return sec, sh, pl, pr


SECT = f"""nn AS (SELECT CAST(l_orderkey AS VARCHAR) AS section_id, count(*) AS n FROM lines GROUP BY 1), sec AS (SELECT s.work_id, s.segment_id AS section_id, s.ord, s.ord*40000000 + planned_us % 7000000 AS a, s.ord*40000000 + planned_us % 7000000 + n*1234567 AS b, n FROM segments s JOIN nn ON nn.section_id = s.segment_id),
 sh AS (SELECT sec.work_id, sec.section_id, l.ord, CAST(l.l_partkey % 60 AS VARCHAR) AS angle, sec.a + (l.ord - 1)*1234567 + CASE WHEN l.l_suppkey % 20 = 0 THEN 500 ELSE 0 END AS s0, sec.a + l.ord*1234567 AS s1, sec.a, sec.b, sec.ord AS so, n, (b - a)*25 // 1000000 AS frames FROM lines l JOIN sec ON sec.section_id = CAST(l.l_orderkey AS VARCHAR)),
 cf AS (SELECT *, CASE WHEN ord = n THEN frames ELSE {he('(s1 - a)*25', '1000000')} END AS ef FROM sh), pf AS (SELECT *, coalesce(lag(ef) OVER (PARTITION BY section_id ORDER BY ord), 0) AS sf, coalesce(lag(s1) OVER (PARTITION BY section_id ORDER BY ord), a) AS pe FROM cf),
 mc AS (SELECT pf.*, CASE WHEN CAST(angle AS BIGINT) < 50 THEN -CAST(angle AS BIGINT)*100000 END AS off FROM pf), mp AS (SELECT *, a + sf*40000 - off AS p0, a + ef*40000 - off AS p1 FROM mc)"""


@query("multicam_clips", sql(SECT + " SELECT work_id, section_id, so AS sec_ord, ord, angle AS angle_id, sf AS start_frame, ef AS end_frame, p0 AS source_start_us, p1 AS source_end_us FROM mp", "lines", "segments"))
def multicam_clips(spark, d):
    return cp.compile_multicam(*_sections(spark, d), 25, 1)[0]


@query(
    "multicam_findings",
    sql(
        SECT
        + """ SELECT section_id || '/' || ord AS entity_id, 'ANGLE_UNKNOWN' AS rule_id FROM mp WHERE off IS NULL UNION ALL SELECT section_id || '/' || ord, 'SHOT_GAP_OR_OVERLAP' FROM mp WHERE s0 <> pe UNION ALL SELECT section_id || '/' || ord, 'SOURCE_RANGE_INVALID' FROM mp WHERE p1 > 900000001""",
        "lines", "segments",
    ),
)
def multicam_findings(spark, d):
    return cp.compile_multicam(*_sections(spark, d), 25, 1)[2].select(*TWO)


@query("multicam_tracks", sql(SECT + " SELECT work_id, section_id, CAST(ord % 50 AS VARCHAR) AS source_id, a + (ord % 50)*100000 AS start_us, a + (ord % 50)*100000 + ((b - a)*25 // 1000000)*40000 AS end_us FROM sec WHERE ord % 50 IN (SELECT c_custkey FROM customer)", "lines", "segments"))
def multicam_tracks(spark, d):
    return cp.compile_multicam(*_sections(spark, d), 25, 1)[1].drop("gain_db")


@query(
    "section_policy",
    sql(
        """c AS (SELECT work_id, ord, clip_id, start_us, end_us FROM clips), l AS (SELECT *, lag(end_us) OVER (PARTITION BY work_id ORDER BY ord) AS p FROM c)
     SELECT clip_id AS entity_id, 'SESSION_REORDER_NOT_AUTHORIZED' AS rule_id FROM l WHERE start_us < p UNION ALL SELECT DISTINCT a.clip_id, 'SESSION_REUSE_NOT_AUTHORIZED' FROM c a JOIN c b ON a.work_id = b.work_id AND b.ord < a.ord AND a.start_us < b.end_us AND b.start_us < a.end_us""",
        "clips",
    ),
)
def section_policy(spark, d):
    c = fx.clips(spark, d).select("work_id", "ord", F.col("clip_id").alias("section_id"), "start_us", "end_us")
    return cp.check_sections(c, False, False).select(*TWO)


@query(
    "offset_evidence",
    sql(
        """m AS (SELECT ord AS i, CASE WHEN ord % 3 = 0 THEN 'declared-clock' ELSE 'audio-correlation' END AS me, CASE WHEN ord % 3 = 0 THEN CASE WHEN ord % 2 = 0 THEN 'DECLARED' ELSE 'BAD' END WHEN ord % 7 = 1 THEN 'REVIEW_NEEDED' ELSE 'CONSISTENT' END AS st, ord % 11 AS off FROM sources WHERE ord % 5 <> 4),
     p AS (SELECT ord AS i, ord % 11 + CASE WHEN ord % 13 = 2 THEN 1 ELSE 0 END AS off, ord % 100 = 0 AS ref FROM sources), j AS (SELECT p.i, p.off, ref, me, st, m.off AS mo FROM p LEFT JOIN m USING (i))
     SELECT CAST(i AS VARCHAR) AS entity_id, 'REFERENCE_OFFSET_MUST_BE_ZERO' AS rule_id FROM j WHERE ref AND (off <> 0 OR me IS NOT NULL) UNION ALL SELECT CAST(i AS VARCHAR), 'SYNC_EVIDENCE_MISSING' FROM j WHERE NOT ref AND me IS NULL
     UNION ALL SELECT CAST(i AS VARCHAR), 'SYNC_MEASUREMENT_NOT_CONSISTENT' FROM j WHERE NOT ref AND me <> 'declared-clock' AND st <> 'CONSISTENT' UNION ALL SELECT CAST(i AS VARCHAR), 'CLOCK_DECLARATION_INVALID' FROM j WHERE NOT ref AND me = 'declared-clock' AND st <> 'DECLARED'
     UNION ALL SELECT CAST(i AS VARCHAR), 'SYNC_OFFSET_EVIDENCE_MISMATCH' FROM j WHERE NOT ref AND me IS NOT NULL AND mo <> off
     UNION ALL SELECT clip_id, 'OUTSIDE_DECLARED_CLOCK_COVERAGE' FROM clips JOIN m ON m.i = CAST(source_id AS BIGINT) WHERE me = 'declared-clock' AND (start_us < 2000000 OR end_us > 20000000)""",
        "sources", "clips",
    ),
)
def offset_evidence(spark, d):
    s, i = fx.sources(spark, d), F.col("ord")
    m = s.where("ord % 5 <> 4").select("source_id", F.when(i % 3 == 0, "declared-clock").otherwise("audio-correlation").alias("method"), F.when(i % 3 == 0, F.when(i % 2 == 0, "DECLARED").otherwise("BAD")).when(i % 7 == 1, "REVIEW_NEEDED").otherwise("CONSISTENT").alias("state"),
        (i % 11).alias("offset_us"), F.lit(2_000_000).alias("cover_start_us"), F.lit(20_000_000).alias("cover_end_us"))
    p = s.select("source_id", (i % 11 + F.when(i % 13 == 2, 1).otherwise(0)).alias("offset_us"), (i % 100 == 0).alias("is_reference"))
    u = fx.clips(spark, d).select("source_id", F.col("clip_id").alias("use_id"), F.col("start_us").alias("session_start_us"), F.col("end_us").alias("session_end_us"))
    return cp.check_offsets(p, m, u).select(*TWO)


def _speech(spark, d):
    """Words: event spans of a user; segments: hours that keep two of three words."""
    w = fx.spans(spark, d).select("source_id", F.col("span_id").cast("string").alias("word_id"), "start_us", (F.col("start_us") + 60_000_000).alias("end_us"), F.col("span_id").alias("ord"))
    day = F.expr("start_us div 86400000000")
    picks = w.where("ord % 3 <> 0").select("source_id", day.cast("string").alias("segment_id"), F.col("ord").alias("pos"), "word_id")
    seg = w.groupBy("source_id", day.alias("day")).agg(F.min("start_us").alias("start_us"), (F.max("end_us") - 30_000_000).alias("end_us"))
    seg = seg.select("source_id", F.col("day").cast("string").alias("segment_id"), F.col("day").alias("ord"), "start_us", "end_us", F.col("end_us").alias("covered_end_us"))
    prot = w.where("ord % 50 = 0").select("source_id", "word_id")
    return w, seg, picks, prot


SPEECH = """w AS (SELECT source_id, CAST(span_id AS VARCHAR) AS word_id, start_us AS w0, start_us + 60000000 AS w1, span_id AS o, start_us // 86400000000 AS day FROM spans),
 k AS (SELECT * FROM w WHERE o % 3 <> 0), s AS (SELECT source_id, day, min(w0) AS s0, max(w1) - 30000000 AS s1 FROM w GROUP BY 1, 2),
 g AS (SELECT source_id, day, min(o) AS lo, max(o) AS hi, count(*) AS n, max(w1) AS last FROM k GROUP BY 1, 2)"""


@query(
    "speech_findings",
    sql(
        SPEECH
        + """ SELECT CAST(day AS VARCHAR) AS entity_id, source_id AS work_id, 'SEGMENT_WORDS_NOT_CONTIGUOUS' AS rule_id FROM g WHERE hi - lo + 1 <> n UNION ALL SELECT CAST(day AS VARCHAR), source_id, 'REORDER_NOT_AUTHORIZED' FROM (SELECT *, lag(hi) OVER (PARTITION BY source_id ORDER BY day) AS p FROM g) WHERE lo <= p
     UNION ALL SELECT word_id, k.source_id, 'KEPT_WORD_TRUNCATED' FROM k JOIN s USING (source_id, day) WHERE s0 > w0 OR s1 < w1
     UNION ALL SELECT s.day || '/' || w.word_id, s.source_id, 'UNLISTED_WORD_IN_AUDIO' FROM s JOIN w ON w.source_id = s.source_id AND w0 < s1 AND s0 < w1 WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.word_id = w.word_id AND k.day = s.day)
     UNION ALL SELECT word_id, source_id, 'PROTECTED_WORD_DELETED' FROM w WHERE o % 50 = 0 AND o % 3 = 0 UNION ALL SELECT CAST(s.day AS VARCHAR), s.source_id, 'WORD_TRUNCATED_BY_FRAME_QUANTIZATION' FROM s JOIN g ON g.source_id = s.source_id AND g.day = s.day WHERE s1 < last""",
        "spans",
    ),
)
def speech_findings(spark, d):
    w, seg, picks, prot = _speech(spark, d)
    return cp.compile_speech(w, seg, picks, prot, bin_us=43_200_000_000).select("work_id", *TWO)


@query("speech_decisions", sql("SELECT source_id, CAST(span_id AS VARCHAR) AS word_id, span_id % 3 <> 0 AS kept FROM spans", "spans"))
def speech_decisions(spark, d):
    w, _, picks, _ = _speech(spark, d)
    return cp.speech_decisions(w.withColumn("text", F.col("word_id")), picks)[1]


def _steps(c):
    st = c.select("work_id", F.col("clip_id").alias("step_id"), (F.col("ord") % 3).cast("string").alias("context_id"))
    third = F.expr("(end_us - start_us) div 4")
    ro = c.select("work_id", F.col("clip_id").alias("step_id"), "clip_id", "start_us", third.alias("q"), "ord", F.posexplode(F.array(*[F.lit(x) for x in cp.ROLES])).alias("i", "role"))
    ro = ro.select("work_id", "step_id", "role", "clip_id", (F.col("start_us") + F.col("i") * F.col("q")).alias("start_us"), (F.col("start_us") + (F.col("i") + 1) * F.col("q") + F.when((F.col("ord") % 4 == 0) & (F.col("i") == 1), 9_000_000).otherwise(0)).alias("end_us"), F.lit(300_000).alias("hold_us"))
    dep = c.where("ord > 1").select("work_id", F.col("clip_id").alias("step_id"), F.concat_ws("c", "work_id", F.col("ord") - F.when(F.col("ord") % 5 == 0, 4).otherwise(1)).alias("dep_id"))
    cue = c.select("work_id", F.concat(F.lit("q"), "clip_id").alias("cue_id"), F.col("clip_id").alias("step_id"), (F.col("ord") * 2_000_000).alias("start_us"), (F.col("ord") * 2_000_000 + 100_000).alias("end_us"))
    return st, ro, dep, cue


STEPS = (
    PLACED
    + f""", r AS (SELECT t.work_id, t.clip_id, t.ord, i, t.source_id, start_us AS c0, eff_source_end_us AS c1, speed_num, speed_den, out_start_us, out_end_us, start_us + i*((end_us - start_us) // 4) AS s0, start_us + (i + 1)*((end_us - start_us) // 4) + CASE WHEN ord % 4 = 0 AND i = 1 THEN 9000000 ELSE 0 END AS s1 FROM timeline t, range(3) x(i)),
  o AS (SELECT *, out_start_us + {he('(s0 - c0)*speed_den', 'speed_num')} AS o0, out_start_us + {he('(s1 - c0)*speed_den', 'speed_num')} AS o1 FROM r),
  f AS (SELECT work_id, clip_id, ord, max(CASE i WHEN 0 THEN s1 END) AS b1, max(CASE i WHEN 1 THEN s0 END) AS a0, max(CASE i WHEN 1 THEN s1 END) AS a1, max(CASE i WHEN 2 THEN s0 END) AS r0, max(CASE i WHEN 0 THEN o1 END) AS ob1, max(CASE i WHEN 1 THEN o0 END) AS oa0, max(CASE i WHEN 1 THEN o1 END) AS oa1, max(CASE i WHEN 2 THEN o0 END) AS or0, max(CASE i WHEN 2 THEN o1 END) AS or1 FROM o GROUP BY 1, 2, 3),
  dp AS (SELECT f.*, p.clip_id AS dep, p.ord % 3 AS pc, p.or1 AS pe, f.work_id || 'c' || (f.ord - CASE WHEN f.ord % 5 = 0 THEN 4 ELSE 1 END) AS dn FROM f LEFT JOIN f p ON p.work_id = f.work_id AND p.ord = f.ord - CASE WHEN f.ord % 5 = 0 THEN 4 ELSE 1 END WHERE f.ord > 1)"""
)


@query(
    "step_findings",
    sql(
        STEPS
        + """ SELECT clip_id || '/' || ['before', 'action', 'result'][i + 1] AS entity_id, 'EVENT_NOT_FULLY_VISIBLE' AS rule_id FROM o WHERE s0 < c0 OR s1 > c1 OR o1 > out_end_us UNION ALL SELECT clip_id || '/' || ['before', 'action', 'result'][i + 1], 'READING_WINDOW_TOO_SHORT' FROM o WHERE o1 - o0 < 300000
     UNION ALL SELECT clip_id, 'STEP_CAUSAL_ORDER_VIOLATION' FROM f WHERE a0 < b1 OR r0 < a1 OR oa0 < ob1 OR or0 < oa1 UNION ALL SELECT clip_id || '>' || dn, 'STEP_DEPENDENCY_UNKNOWN_OR_SELF' FROM dp WHERE dep IS NULL
     UNION ALL SELECT clip_id || '>' || dn, 'DEPENDENCY_CONTEXT_MISMATCH' FROM dp WHERE pc <> ord % 3 UNION ALL SELECT clip_id || '>' || dn, 'STEP_DEPENDENCY_ORDER_VIOLATION' FROM dp WHERE pe > oa0
     UNION ALL SELECT 'q' || clip_id, 'RESULT_CUE_OUTSIDE_EVIDENCE_WINDOW' FROM f WHERE ord*2000000 < or0 OR ord*2000000 + 100000 > or1""",
        "clips",
    ),
)
def step_findings(spark, d):
    t = placed(spark, d)
    return cp.step_map(*_steps(t), t)[1].select(*TWO)


@query("step_map", sql(STEPS + " SELECT work_id, clip_id AS step_id, oa0 AS action_o0, oa1 AS action_o1, or1 AS result_o1 FROM f", "clips"))
def step_map(spark, d):
    t = placed(spark, d)
    return cp.step_map(*_steps(t), t)[0].select("work_id", "step_id", "action_o0", "action_o1", "result_o1")


def _evidence(c):
    """Units: source ranges of every clip (some longer than it); occurrences: the clips."""
    u = c.select("work_id", F.concat(F.lit("u"), "clip_id").alias("unit_id"), F.when(F.col("ord") % 6 == 5, "zz").otherwise(F.col("source_id")).alias("source_id"), (F.col("start_us") + 200_000).alias("start_us"), (F.col("end_us") - F.when(F.col("ord") % 4 == 0, -700_000).otherwise(300_000)).alias("end_us")).where("end_us > start_us")
    oc = u.select("work_id", F.concat(F.lit("o"), F.substring("unit_id", 2, 99)).alias("occurrence_id"), "unit_id")
    ca = oc.select("work_id", "occurrence_id", F.substring("unit_id", 2, 99).alias("carrier_id"))
    return u, oc, ca


EVID = (
    PLACED
    + f""", u AS (SELECT work_id, clip_id, ord, CASE WHEN ord % 6 = 5 THEN 'zz' ELSE source_id END AS us, start_us + 200000 AS u0, end_us - CASE WHEN ord % 4 = 0 THEN -700000 ELSE 300000 END AS u1 FROM clips),
  ep AS (SELECT u.*, t.source_id AS cs, greatest(u0, t.start_us) AS s0, least(u1, t.eff_source_end_us) AS s1, t.start_us AS c0, t.out_start_us, t.speed_num, t.speed_den FROM u JOIN timeline t ON t.work_id = u.work_id AND t.clip_id = u.clip_id WHERE u1 > u0),
  em AS (SELECT *, out_start_us + {he('(s0 - c0)*speed_den', 'speed_num')} AS o0, out_start_us + {he('greatest(s1 - c0, 0)*speed_den', 'speed_num')} AS o1 FROM ep),
  mapped AS (SELECT work_id, 'o' || clip_id AS occurrence_id, 'u' || clip_id AS unit_id, o0 AS out_start_us, o1 AS out_end_us, ord, s1 <> u1 AS cut FROM em WHERE cs = us AND s1 > s0)"""
)


def _mapped(spark, d, timeline):
    """Units, occurrences and carriers are read from the timeline, so that they lie by work and meet without a shuffle."""
    return cp.evidence_map(*_evidence(timeline), timeline, retime=True, counted=_evidence(timeline.stored)[2])


def _mapped_table(spark, d, timeline):
    """The mapped occurrences as a stored table, and the clips' names by work, which its readers need of the timeline."""
    m = by_work(written(_mapped(spark, d, timeline)[0], "mapped"), "n_parts")
    return m, lying(timeline.stored.select("work_id", "ord", "clip_id"), ["work_id"])


query("evidence_map", sql(EVID + " SELECT work_id, occurrence_id, unit_id, out_start_us, out_end_us, 1 AS n_parts FROM mapped", "clips"))(lambda s, d: _mapped(s, d, placed(s, d))[0])
query(
    "evidence_findings",
    sql(EVID + """ SELECT 'o' || clip_id || '/' || clip_id AS entity_id, 'EVIDENCE_SOURCE_MISMATCH' AS rule_id FROM em WHERE cs <> us UNION ALL SELECT 'o' || clip_id || '/' || clip_id, 'CARRIER_DOES_NOT_COVER_UNIT' FROM em WHERE s1 <= s0 UNION ALL SELECT occurrence_id, 'EVIDENCE_TRUNCATED_REORDERED_OR_REPEATED' FROM mapped WHERE cut""", "clips"),
)(lambda s, d: _mapped(s, d, placed(s, d))[1].select(*TWO))


@query(
    "dependency_checks",
    sql(
        EVID
        + """, rq AS (SELECT work_id, 'u' || clip_id AS unit_id, 'u' || work_id || 'c' || (ord - 1) AS dep_unit, CASE WHEN ord % 2 = 0 THEN 'prerequisite' ELSE 'context' END AS rel, ord FROM clips WHERE ord > 1),
     nd AS (SELECT m.work_id, m.occurrence_id, m.out_start_us, rq.dep_unit, rel FROM mapped m JOIN rq ON rq.work_id = m.work_id AND rq.unit_id = m.unit_id),
     dp AS (SELECT work_id, 'o' || clip_id AS occurrence_id, 'u' || work_id || 'c' || (ord - 1) AS dep_unit, 'o' || work_id || 'c' || (ord - CASE WHEN ord % 7 = 3 THEN 2 ELSE 1 END) AS dep_occ FROM clips WHERE ord > 1 AND ord % 5 <> 0),
     j AS (SELECT coalesce(nd.work_id, dp.work_id) AS work_id, coalesce(nd.occurrence_id, dp.occurrence_id) AS occ, coalesce(nd.dep_unit, dp.dep_unit) AS du, rel, out_start_us, dep_occ FROM nd FULL JOIN dp ON nd.work_id = dp.work_id AND nd.occurrence_id = dp.occurrence_id AND nd.dep_unit = dp.dep_unit),
     k AS (SELECT j.*, p.unit_id AS pu, p.out_end_us AS pe FROM j LEFT JOIN mapped p ON p.work_id = j.work_id AND p.occurrence_id = j.dep_occ WHERE rel IS NOT NULL AND dep_occ IS NOT NULL)
     SELECT occ || '>' || du AS entity_id, 'DEPENDENCY_BINDING_MISMATCH' AS rule_id FROM j WHERE rel IS NULL OR dep_occ IS NULL UNION ALL SELECT occ || '>' || du, 'DEPENDENCY_OCCURRENCE_MISSING_OR_SELF' FROM k WHERE pu IS NULL OR dep_occ = occ
     UNION ALL SELECT occ || '>' || du, 'DEPENDENCY_OCCURRENCE_WRONG_UNIT' FROM k WHERE pu <> du UNION ALL SELECT occ || '>' || du, 'PREREQUISITE_NOT_BEFORE_UNIT' FROM k WHERE rel = 'prerequisite' AND pe > out_start_us""",
        "clips",
    ),
)
def dependency_checks(spark, d):
    m, t = _mapped_table(spark, d, placed(spark, d))
    c = t.where("ord > 1")
    prev = F.concat(F.lit("u"), "work_id", F.lit("c"), F.col("ord") - 1)
    rq = c.select("work_id", F.concat(F.lit("u"), "clip_id").alias("unit_id"), prev.alias("dep_unit_id"), F.when(F.col("ord") % 2 == 0, "prerequisite").otherwise("context").alias("relation"))
    dp = c.where("ord % 5 <> 0").select("work_id", F.concat(F.lit("o"), "clip_id").alias("occurrence_id"), prev.alias("dep_unit_id"), F.concat(F.lit("o"), "work_id", F.lit("c"), F.col("ord") - F.when(F.col("ord") % 7 == 3, 2).otherwise(1)).alias("dep_occurrence_id"))
    return cp.check_dependencies(m, rq, dp).select(*TWO)


@query("missing_required", sql("SELECT work_id, 'u' || clip_id AS unit_id FROM clips WHERE ord % 3 = 0 AND NOT EXISTS (SELECT 1 FROM clips q WHERE q.clip_id = clips.clip_id AND q.gain_db < -4)", "clips"))
def missing_required(spark, d):
    c = fx.clips(spark, d)
    u = F.concat(F.lit("u"), "clip_id").alias("unit_id")
    return cp.missing_required(c.where("ord % 3 = 0").select("work_id", u), c.where("gain_db < -4").select("work_id", u))


CHAP = EVID + """, mb AS (SELECT work_id, 'k' || ((ord - 1) // 2) AS chapter_id, (ord - 1) // 2 AS ord, 'o' || clip_id AS occurrence_id FROM clips WHERE ord % 7 <> 6), cj AS (SELECT mb.*, m.out_start_us AS s, m.out_end_us AS e FROM mb LEFT JOIN mapped m USING (work_id, occurrence_id)),
 cg AS (SELECT work_id, chapter_id, ord, min(s) AS start_us, max(e) AS end_us, count(s) AS n_occurrences FROM cj GROUP BY 1, 2, 3)"""


def _chapters(spark, d):
    k = F.expr("(ord - 1) div 2")
    m, c = _mapped_table(spark, d, placed(spark, d))
    mb = lambda t: t.where("ord % 7 <> 6").select("work_id", F.concat(F.lit("k"), k).alias("chapter_id"), k.alias("ord"), F.concat(F.lit("o"), "clip_id").alias("occurrence_id"))
    return cp.chapters(mb(c), m, counted=mb(c.stored))


query("chapters", sql(CHAP + " SELECT * FROM cg", "clips"))(lambda s, d: _chapters(s, d)[0])
query(
    "chapter_findings",
    sql(CHAP + """ SELECT chapter_id || '/' || occurrence_id AS entity_id, 'CHAPTER_OCCURRENCE_UNKNOWN' AS rule_id FROM cj WHERE s IS NULL UNION ALL SELECT occurrence_id, 'UNCHAPTERED_OCCURRENCE' FROM mapped m WHERE (work_id, occurrence_id) NOT IN (SELECT work_id, occurrence_id FROM mb) AND work_id IN (SELECT work_id FROM mb)
     UNION ALL SELECT chapter_id, 'CHAPTER_ORDER_INVALID' FROM (SELECT *, lag(start_us) OVER (PARTITION BY work_id ORDER BY ord) AS p FROM cg) WHERE start_us < p""", "clips"),
)(lambda s, d: _chapters(s, d)[1].select(*TWO))


@query(
    "layer_hits",
    sql(
        LAYERS + ", " + EVID[len(PLACED) + 2 :] + f""", lu AS (SELECT work_id, layer_id, z, {he('greatest(s, 0)*1000000*1001', '30000')} AS a, {he('greatest(s + fr, 0)*1000000*1001', '30000')} AS b FROM lp WHERE ord % 6 <> 2 AND s >= 0)
     SELECT m.work_id, m.occurrence_id, coalesce(string_agg(layer_id, ',' ORDER BY z, layer_id), '') AS layer_ids FROM mapped m LEFT JOIN lu ON lu.work_id = m.work_id AND lu.a < m.out_end_us AND m.out_start_us < lu.b GROUP BY 1, 2""",
        "clips",
    ),
)
def layer_hits(spark, d):
    t = placed(spark, d)
    y = cp.normalize_layers(layers(t), t, canvas(t))[0].where("start_frame >= 0").select("work_id", "layer_id", "z", "start_frame", "end_frame", "opacity")
    m, y = _mapped_table(spark, d, t)[0], by_work(written(y, "layers"))
    return cp.layer_hits(m, y, fx.FPS_NUM, fx.FPS_DEN, counted=(m.stored, y.stored)).withColumn("layer_ids", F.array_join("layer_ids", ","))


def _events(spark, d):
    m, c = _mapped_table(spark, d, placed(spark, d))
    e = F.expr("(ord - 1) div 3")
    ro = c.where("ord % 10 <> 9").select("work_id", F.concat(F.lit("e"), e).alias("event_id"), F.element_at(F.array(*[F.lit(x) for x in cp.PHASES]), ((F.col("ord") - 1) % 3 + 1).cast("int")).alias("role"), F.concat(F.lit("o"), "clip_id").alias("occurrence_id"))
    ev = c.select("work_id", e.alias("k")).distinct().select("work_id", F.concat(F.lit("e"), "k").alias("event_id"), F.col("k").alias("ord"), F.when(F.col("k") == 1, "replay").when(F.col("k") == 2, "open").otherwise("complete").alias("mode"), F.when(F.col("k") == 1, "e0").when(F.col("k") == 3, "e0").alias("replay_of"))
    return cp.event_map(ev, ro, m)


EVENTS = EVID + """, ro AS (SELECT work_id, (ord - 1) // 3 AS k, (ord - 1) % 3 AS r, 'o' || clip_id AS occurrence_id FROM clips WHERE ord % 10 <> 9), ev AS (SELECT DISTINCT work_id, (ord - 1) // 3 AS k FROM clips),
 rj AS (SELECT ro.*, m.out_start_us AS s, m.out_end_us AS e FROM ro LEFT JOIN mapped m USING (work_id, occurrence_id)),
 eg AS (SELECT ev.work_id, ev.k, min(CASE r WHEN 0 THEN s END) AS s0, max(CASE r WHEN 0 THEN e END) AS s1, min(CASE r WHEN 1 THEN s END) AS a0, max(CASE r WHEN 1 THEN e END) AS a1, min(CASE r WHEN 2 THEN s END) AS o0, min(s) AS st, max(e) AS en FROM ev LEFT JOIN rj ON rj.work_id = ev.work_id AND rj.k = ev.k GROUP BY 1, 2)"""

query("event_map", sql(EVENTS + " SELECT work_id, 'e' || k AS event_id, CASE k WHEN 1 THEN 'replay' WHEN 2 THEN 'open' ELSE 'complete' END AS mode, CASE WHEN k = 1 THEN 'e0' ELSE 'e' || k END AS canonical_id, st AS out_start_us, en AS out_end_us FROM eg", "clips"))(lambda s, d: _events(s, d)[0])
query("event_counts", sql(EVENTS + " SELECT work_id, count(CASE WHEN k <> 1 THEN 1 END) AS n_primary, count(CASE WHEN k = 1 THEN 1 END) AS n_replay, count(CASE WHEN k = 2 THEN 1 END) AS n_open FROM eg GROUP BY 1", "clips"))(lambda s, d: cp.event_counts(_events(s, d)[0]))
query(
    "event_findings",
    sql(EVENTS + """ SELECT 'e' || k || '/' || occurrence_id AS entity_id, work_id, 'EVENT_OCCURRENCE_UNKNOWN' AS rule_id FROM rj WHERE s IS NULL UNION ALL SELECT occurrence_id, work_id, 'UNASSIGNED_EVENT_OCCURRENCE' FROM mapped WHERE (work_id, occurrence_id) NOT IN (SELECT work_id, occurrence_id FROM ro)
     UNION ALL SELECT 'e' || k, work_id, 'EVENT_ACTION_REQUIRED' FROM eg WHERE a0 IS NULL UNION ALL SELECT 'e' || k, work_id, 'COMPLETE_EVENT_NEEDS_SETUP_AND_OUTCOME' FROM eg WHERE k NOT IN (1, 2) AND (s0 IS NULL OR o0 IS NULL)
     UNION ALL SELECT 'e' || k, work_id, 'EVENT_PHASE_ORDER_VIOLATION' FROM eg WHERE coalesce(a0 < s1, false) OR coalesce(o0 < coalesce(a1, s1), false) UNION ALL SELECT 'e' || k, work_id, 'REPLAY_PRECEDES_ORIGINAL_END' FROM eg WHERE k = 1 AND a0 < (SELECT en FROM eg x WHERE x.work_id = eg.work_id AND x.k = 0)
     UNION ALL SELECT 'e' || k, work_id, 'PRIMARY_EVENT_CANNOT_DECLARE_REPLAY' FROM eg WHERE k = 3""", "clips"),
)(lambda s, d: _events(s, d)[1].select("work_id", *TWO))


@query(
    "replay_cover",
    sql(
        """t AS (SELECT work_id, clip_id, start_us AS a, end_us AS b FROM clips WHERE ord = 1), l AS (SELECT work_id, clip_id AS cap, start_us - 1000000 AS a, end_us + 6000000 AS b, CASE WHEN ord % 3 = 0 THEN 'again' WHEN ord % 3 = 1 THEN 'instant REPLAY' ELSE '回放' END AS tx FROM clips WHERE ord < 5),
     c AS (SELECT t.work_id, t.clip_id, t.a AS t0, t.b AS t1, greatest(t.a, l.a) AS s, least(t.b, l.b) AS e FROM t JOIN l ON l.work_id = t.work_id AND l.cap <> t.clip_id AND l.a < t.b AND t.a < l.b), m AS (SELECT *, max(e) OVER (PARTITION BY work_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM c),
     g AS (SELECT work_id, bool_or(s > coalesce(reach, t0)) OR max(e) < max(t1) AS hole FROM m GROUP BY 1)
     SELECT cap AS entity_id, 'EXPLICIT_REPLAY_TEXT_REQUIRED' AS rule_id FROM l WHERE tx = 'again' AND cap NOT IN (SELECT clip_id FROM t) UNION ALL SELECT t.clip_id, 'REPLAY_LABEL_NOT_COVERING_ACTION' FROM t LEFT JOIN g USING (work_id) WHERE coalesce(hole, true)""",
        "clips",
    ),
)
def replay_cover(spark, d):
    c = written(fx.clips(spark, d).where("ord < 5").select("work_id", "ord", "clip_id", "start_us", "end_us"), "clips")  # read by the labels, the actions and each step of their cover
    e = F.lit("e").alias("event_id")
    a = c.where("ord = 1").select("work_id", e, F.col("clip_id").alias("occurrence_id"), "start_us", "end_us")
    txt = F.when(F.col("ord") % 3 == 0, "again").when(F.col("ord") % 3 == 1, "instant REPLAY").otherwise("回放")
    lab = c.where("ord < 5 and ord > 1").select("work_id", e, F.col("clip_id").alias("caption_id"), (F.col("start_us") - 1_000_000).alias("start_us"), (F.col("end_us") + 6_000_000).alias("end_us"), txt.alias("text"))
    return cp.replay_cover(a, lab).select(*TWO)


@query(
    "localization_findings",
    sql(
        r"""u AS (SELECT source_id AS w, cue_id AS un, speaker AS sp, ord, start_us, end_us, text FROM cues), q AS (SELECT w, 'q' || un AS cue, CASE WHEN ord = 5 THEN 'none' ELSE un END AS un, CASE WHEN ord % 4 = 3 THEN 'other' ELSE sp END AS sp, start_us, end_us + CASE WHEN ord % 6 = 1 THEN 100000 ELSE 0 END AS end_us, text, ord FROM u WHERE ord <> 2),
     om AS (SELECT w, un FROM u WHERE ord IN (2, 4)), pr AS (SELECT w, un FROM u WHERE ord % 4 = 0), k AS (SELECT q.*, u.sp AS us FROM q LEFT JOIN u ON u.w = q.w AND u.un = q.un),
     z AS (SELECT *, length(regexp_replace(text, '\s+', '', 'g')) AS n, len(string_split(text, chr(10))) AS nl, list_max(list_transform(string_split(text, chr(10)), lambda s: length(regexp_replace(s, '\s+', '', 'g')))) AS mx FROM q)
     SELECT cue || '/' || un AS entity_id, 'CUE_SOURCE_UNKNOWN' AS rule_id FROM k WHERE us IS NULL UNION ALL SELECT cue || '/' || un, 'SOURCE_BOTH_USED_AND_OMITTED' FROM q WHERE (w, un) IN (SELECT * FROM om) UNION ALL SELECT un, 'PROTECTED_SOURCE_OMITTED' FROM pr WHERE (w, un) IN (SELECT * FROM om)
     UNION ALL SELECT un, 'SOURCE_COVERAGE_INCOMPLETE' FROM u WHERE (w, un) NOT IN (SELECT w, un FROM q) AND (w, un) NOT IN (SELECT * FROM om) UNION ALL SELECT cue, 'SPEAKER_MAPPING_MISMATCH' FROM k WHERE us IS NULL OR us <> sp
     UNION ALL SELECT cue, 'OVERLAPPING_TARGET_CUES' FROM (SELECT *, lag(end_us) OVER (PARTITION BY w ORDER BY start_us, end_us) AS p FROM q) WHERE start_us < p UNION ALL SELECT cue, 'READING_PROFILE_EXCEEDED' FROM z WHERE nl > 2 OR mx > 150 OR n*1000000 > 14*(end_us - start_us)
     UNION ALL SELECT cue, 'DUB_EXCEEDS_SLOT' FROM q WHERE length(text)*61000 > end_us - start_us""",
        "cues",
    ),
)
def localization_findings(spark, d):
    c = fx.cues(spark, d).withColumnRenamed("source_id", "work_id")
    u = c.select("work_id", F.col("cue_id").alias("unit_id"), F.col("speaker").alias("speaker_id"))
    q = c.where("ord <> 2").select("work_id", F.concat(F.lit("q"), "cue_id").alias("cue_id"), F.array(F.when(F.col("ord") == 5, "none").otherwise(F.col("cue_id"))).alias("unit_ids"), F.array(F.when(F.col("ord") % 4 == 3, "other").otherwise(F.col("speaker"))).alias("speaker_ids"),
        "start_us", (F.col("end_us") + F.when(F.col("ord") % 6 == 1, 100_000).otherwise(0)).alias("end_us"), "text", (F.length("text") * 61_000).alias("audio_us"))
    one = lambda cond: c.where(cond).select("work_id", F.col("cue_id").alias("unit_id"))
    return cp.compile_localization(u, q, one("ord in (2, 4)"), one("ord % 4 = 0"), {"max_lines": 2, "max_line": 150, "max_cps": 14}, dub=True).select(*TWO)


@query(
    "caption_cover",
    sql(
        """r AS (SELECT source_id AS w, cue_id AS req, text, ord, start_us + 1000 AS a, end_us + CASE WHEN ord % 3 = 0 THEN 50000 ELSE -500 END AS b, 2000000 AS mn FROM cues),
     l AS (SELECT r.w, r.req, k AS dk FROM r, range(2) x(k)), j AS (SELECT r.*, c.cue_id AS cap, c.text AS ct, c.start_us AS c0, c.end_us AS c1, r.w || ':' || (r.ord + dk) AS want FROM r JOIN l USING (w, req) LEFT JOIN cues c ON c.source_id = r.w AND c.ord = r.ord + dk),
     p AS (SELECT w, req, a, b, mn, greatest(a, c0) AS s, least(b, c1) AS e FROM j WHERE greatest(a, c0) < least(b, c1)), m AS (SELECT *, max(e) OVER (PARTITION BY req ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM p),
     g AS (SELECT req, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) AS n, min(s) AS m0, max(e) AS m1 FROM m GROUP BY 1)
     SELECT req || '/' || want AS entity_id, 'CAPTION_ID_UNKNOWN' AS rule_id FROM j WHERE ct IS NULL UNION ALL SELECT req || '/' || want, 'CAPTION_TEXT_MISMATCH' FROM j WHERE ct <> text
     UNION ALL SELECT req, 'MINIMUM_EXCEEDS_WINDOW' FROM r WHERE mn > b - a UNION ALL SELECT r.req, 'CAPTION_WINDOW_NOT_COVERED' FROM r LEFT JOIN g USING (req) WHERE NOT coalesce(n = 1 AND m0 <= a AND m1 >= b, false) UNION ALL SELECT r.req, 'CONTINUOUS_DURATION_TOO_SHORT' FROM r LEFT JOIN g USING (req) WHERE coalesce(CASE WHEN n = 1 THEN m1 - m0 END, 0) < mn""",
        "cues",
    ),
)
def caption_cover(spark, d):
    c = fx.cues(spark, d).withColumnRenamed("source_id", "work_id")
    r = c.select("work_id", F.col("cue_id").alias("req_id"), "text", F.lit("exact").alias("match"), (F.col("start_us") + 1000).alias("start_us"), (F.col("end_us") + F.when(F.col("ord") % 3 == 0, 50_000).otherwise(-500)).alias("end_us"), F.lit(2_000_000).alias("min_us"))
    ln = c.select("work_id", F.col("cue_id").alias("req_id"), F.explode(F.array(F.col("ord"), F.col("ord") + 1)).alias("k")).select("work_id", "req_id", F.concat_ws(":", "work_id", "k").alias("caption_id"))
    return cp.caption_cover(r, c.withColumnRenamed("cue_id", "caption_id"), ln).select(*TWO)


@query(
    "cue_alignment",
    sql(
        PLACED
        + f""", k AS (SELECT t.*, frames // 2 + CASE WHEN ord % 8 = 7 THEN 1000 ELSE 0 END AS fo, end_us - start_us AS ln FROM timeline t), c AS (SELECT work_id, clip_id, ord, out_start_frame + fo AS frame, {he('CAST(out_start_frame + fo AS HUGEINT)*1000000*fps_den', 'fps_num')} AS v, out_start_us + ln // 3 - 0 AS au, fo > frames AS badf, fo = frames AS bd, ln, CASE WHEN ord % 9 = 4 THEN true ELSE false END AS nomark FROM k)
     SELECT work_id, clip_id AS check_id, frame, v AS visual_us, CASE WHEN nomark THEN NULL ELSE au END AS audio_us, CASE WHEN nomark THEN NULL ELSE v - au END AS error_us, CASE WHEN nomark THEN 'MARKER_UNKNOWN' WHEN badf THEN 'FRAME_OFFSET_INVALID' WHEN abs(v - au) <= 1500000 THEN 'ALIGNED' ELSE 'MISALIGNED' END AS state, bd AS boundary FROM c""",
        "clips",
    ),
)
def cue_alignment(spark, d):
    t = placed(spark, d)
    ln = F.col("end_us") - F.col("start_us")
    ck = t.select("work_id", F.col("clip_id").alias("check_id"), F.col("clip_id").alias("track_id"), F.when(F.col("ord") % 9 == 4, "none").otherwise(F.col("clip_id")).alias("marker_id"), "clip_id", (F.expr("frames div 2") + F.when(F.col("ord") % 8 == 7, 1000).otherwise(0)).alias("frame_offset"), F.lit(0).alias("want_us"), F.lit(1_500_000).alias("tol_us"))
    mk = t.select("work_id", F.col("clip_id").alias("marker_id"), (F.col("start_us") + F.call_function("div", ln, F.lit(3))).alias("t_us"), F.lit(40).alias("uncertainty_us"))
    tr = t.select("work_id", F.col("clip_id").alias("track_id"), "start_us", "end_us", "out_start_us")
    return cp.cue_alignment(ck, mk, tr, t).drop("uncertainty_us")
