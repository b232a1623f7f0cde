"""Queries of the timeline operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanframe import fixtures as fx
from spanframe.catalog.cte import sql
from spanframe.catalog.registry import query
from spanframe.operators import timeline as tl
from spanframe.plans.ordered import lying
from spanframe.plans.rounds import written


def he(n: str, d: str) -> str:
    """Half-even quotient in SQL for n >= 0."""
    n, d = f"CAST({n} AS HUGEINT)", f"CAST({d} AS HUGEINT)"
    return f"CAST(({n} // {d}) + CASE WHEN 2*({n} % {d}) > {d} OR (2*({n} % {d}) = {d} AND ({n} // {d}) % 2 = 1) THEN 1 ELSE 0 END AS BIGINT)"


def hu(n: str, d: str) -> str:
    return f"CAST((2*CAST({n} AS HUGEINT) + {d}) // (2*{d}) AS BIGINT)"


FR = he("CAST(end_us - start_us AS HUGEINT)*fps_num*speed_den", "CAST(1000000 AS HUGEINT)*fps_den*speed_num")
PLACED = f"""fr AS (SELECT *, {FR} AS frames FROM clips),
 fe AS (SELECT *, CAST(sum(frames) OVER (PARTITION BY work_id ORDER BY ord) AS BIGINT) AS out_end_frame FROM fr),
 timeline AS (SELECT *, out_end_frame - frames AS out_start_frame,
  {he('CAST(out_end_frame - frames AS HUGEINT)*1000000*fps_den', 'fps_num')} AS out_start_us,
  {he('CAST(out_end_frame AS HUGEINT)*1000000*fps_den', 'fps_num')} AS out_end_us,
  least(end_us, start_us + {he('CAST(frames AS HUGEINT)*1000000*fps_den*speed_num', 'fps_num*speed_den')}) AS eff_source_end_us,
  {he('CAST(frames AS HUGEINT)*1000000*fps_den', 'fps_num')} - {he('(end_us - start_us)*speed_den', 'speed_num')} AS quant_delta_us FROM fe)"""


@query(
    "place_clips",
    sql(PLACED + " SELECT work_id, ord, clip_id, frames, out_start_frame, out_end_frame, out_start_us, out_end_us, eff_source_end_us, quant_delta_us FROM timeline", "clips"),
)
def place_clips(spark, d):
    return tl.place_clips(fx.clips(spark, d)).select(
        "work_id", "ord", "clip_id", "frames", "out_start_frame", "out_end_frame", "out_start_us", "out_end_us", "eff_source_end_us", "quant_delta_us"
    )


def placed(spark, d):
    """The compiled timeline, and so all clips, as a stored table whose readers share one shuffle by work."""
    return by_work(written(tl.place_clips(fx.clips(spark, d)), "placed"), "quant_delta_us", "mute")


def by_work(t, *unread):
    """A stored table by work, without the ``unread`` columns."""
    return lying(t.drop(*unread), ["work_id"])


@query("frame_count", sql(f"SELECT clip_id, {FR} AS frames FROM clips", "clips"))
def frame_count(spark, d):
    return tl.frame_count(fx.clips(spark, d)).select("clip_id", "frames")


MAPPED = (
    PLACED
    + f""", p AS (SELECT t.*, c.cue_id, c.text, c.start_us AS cs, c.end_us AS ce, greatest(c.start_us, t.start_us) AS l, least(c.end_us, t.eff_source_end_us) AS r
  FROM timeline t JOIN cues c ON c.source_id = t.source_id AND c.start_us < t.eff_source_end_us AND t.start_us < c.end_us),
 q AS (SELECT work_id, clip_id, cue_id, out_start_us + {he('(l - start_us)*speed_den', 'speed_num')} AS start_us,
  least(out_end_us, out_start_us + {he('(r - start_us)*speed_den', 'speed_num')}) AS end_us, l > cs OR r < ce AS partial FROM p)"""
)


@query("map_cues_clip", sql(MAPPED + " SELECT * FROM q WHERE start_us < end_us", "clips", "cues"))
def map_cues_clip(spark, d):
    return tl.map_cues(fx.cues(spark, d), tl.place_clips(fx.clips(spark, d)), "clip")[0].drop("text")


@query("map_cues_reject", sql(MAPPED + " SELECT work_id, cue_id AS entity_id, clip_id AS evidence, 'PARTIAL_CUE' AS rule_id FROM q WHERE partial UNION ALL SELECT work_id, cue_id, clip_id, 'CUE_LOST_TO_FRAME_QUANTIZATION' FROM q WHERE start_us >= end_us", "clips", "cues"))
def map_cues_reject(spark, d):
    return tl.map_cues(fx.cues(spark, d), tl.place_clips(fx.clips(spark, d)), "reject-partial")[1].select("work_id", "entity_id", "evidence", "rule_id")


NOMINAL = """tot AS (SELECT work_id, segment_id, sum(end_us - start_us) AS visual_us FROM visuals GROUP BY 1, 2),
 sd AS (SELECT s.*, coalesce(t.visual_us, 0) AS visual_us, CAST(CASE WHEN mode = 'voiceover' AND voice_us > 0 THEN voice_us ELSE coalesce(t.visual_us, 0) END AS BIGINT) AS dur_us
  FROM segments s LEFT JOIN tot t ON t.work_id = s.work_id AND t.segment_id = s.segment_id),
 nominal AS (SELECT *, CAST(sum(dur_us) OVER (PARTITION BY work_id ORDER BY ord) AS BIGINT) AS out_end_us FROM sd)"""


@query("nominal_timeline", sql(NOMINAL + " SELECT work_id, ord, segment_id, dur_us, out_end_us - dur_us AS out_start_us, out_end_us FROM nominal", "segments", "visuals"))
def nominal_timeline(spark, d):
    return tl.nominal_timeline(fx.segments(spark, d), fx.visuals(spark, d)).select("work_id", "ord", "segment_id", "dur_us", "out_start_us", "out_end_us")


@query(
    "quantize_cues",
    sql(f"SELECT cue_id, {hu('start_us*30000', '1001000000')} AS start_us_q, start_us*30000 - {hu('start_us*30000', '1001000000')}*1001000000 AS start_us_q_rest FROM cues", "cues"),
)
def quantize_cues(spark, d):
    return tl.quantize(fx.cues(spark, d), ["start_us"], 30000, 1001).select("cue_id", "start_us_q", "start_us_q_rest")


def facts(spark, d):
    """Measured segment facts near the nominal length, with some drifting segments."""
    s = tl.segment_durations(fx.segments(spark, d), fx.visuals(spark, d))
    n = F.expr("(dur_us*30 + 500000) div 1000000")
    bump = F.when(F.col("ord") % 9 == 0, 2).otherwise(0)
    return s.select(
        "work_id", "segment_id", (n + bump).alias("frame_count"), ((n + bump) * 1600).alias("sample_count"), ((n + bump) * 1600 + 512).alias("decoded_sample_count"),
        F.lit(512).cast("bigint").alias("padding"), F.lit(1024).cast("bigint").alias("encoder_delay"), F.lit(30).cast("bigint").alias("fps_num"), F.lit(1).cast("bigint").alias("fps_den"),
        F.lit(48000).cast("bigint").alias("sample_rate"),
    )


REALIZED = (
    NOMINAL
    + """, fx AS (SELECT *, (dur_us*30 + 500000) // 1000000 + CASE WHEN ord % 9 = 0 THEN 2 ELSE 0 END AS fc FROM nominal),
 rt AS (SELECT *, CAST(sum(fc) OVER (PARTITION BY work_id ORDER BY ord) AS BIGINT) AS end_frame FROM fx)"""
)


@query(
    "realized_timeline",
    sql(REALIZED + " SELECT work_id, ord, segment_id, end_frame - fc AS start_frame, end_frame, (end_frame - fc)*1600 AS start_sample, end_frame*1600 AS end_sample, CAST(0 AS BIGINT) AS sample_rest, out_end_us AS nominal_end_us FROM rt", "segments", "visuals"),
)
def realized_timeline(spark, d):
    return tl.realized_timeline(fx.segments(spark, d), fx.visuals(spark, d), facts(spark, d), 30, 1)[0]


@query(
    "realized_findings",
    sql(
        REALIZED
        + """ SELECT segment_id AS entity_id, 'REALIZED_FRAME_COUNT_MISSING' AS rule_id FROM rt WHERE fc <= 0 UNION ALL SELECT segment_id, 'REALIZED_SAMPLE_COUNT_MISSING' FROM rt WHERE fc <= 0
     UNION ALL SELECT segment_id, 'REALIZED_DURATION_DRIFT' FROM rt WHERE abs(fc*1000000 - dur_us*30) > 1000000
     UNION ALL SELECT segment_id, 'REALIZED_CUMULATIVE_DRIFT' FROM rt WHERE abs(end_frame*1000000 - out_end_us*30) > 1000000""",
        "segments", "visuals",
    ),
)
def realized_findings(spark, d):
    return tl.realized_timeline(fx.segments(spark, d), fx.visuals(spark, d), facts(spark, d), 30, 1)[1].select("entity_id", "rule_id")


USED = """cv AS (SELECT v.*, s.mode, coalesce(CASE WHEN s.voice_us > 0 THEN s.voice_us END, s.planned_us) AS budget,
  CAST(sum(v.end_us - v.start_us) OVER (PARTITION BY v.work_id, v.segment_id ORDER BY v.ord) AS BIGINT) - (v.end_us - v.start_us) AS local_us
  FROM visuals v JOIN segments s ON s.work_id = v.work_id AND s.segment_id = v.segment_id),
 used AS (SELECT * FROM (SELECT *, CASE WHEN mode = 'original' THEN end_us - start_us ELSE least(end_us - start_us, budget - local_us) END AS used_us FROM cv) WHERE used_us > 0)"""


@query("consume_budget", sql(USED + " SELECT work_id, segment_id, ord, source_id, start_us, start_us + used_us AS end_us, used_us, local_us FROM used", "segments", "visuals"))
def consume_budget(spark, d):
    return tl.consume_visuals(fx.segments(spark, d), fx.visuals(spark, d)).select("work_id", "segment_id", "ord", "source_id", "start_us", "end_us", "used_us", "local_us")


@query(
    "build_edl",
    sql(
        NOMINAL + ", " + USED
        + """ SELECT u.work_id, n.ord AS seg_ord, u.segment_id, u.ord, u.source_id, u.start_us, u.start_us + used_us AS end_us, n.out_end_us - n.dur_us + local_us AS out_start_us,
     n.out_end_us - n.dur_us + local_us + used_us AS out_end_us, unit_id FROM used u JOIN nominal n ON n.work_id = u.work_id AND n.segment_id = u.segment_id""",
        "segments", "visuals",
    ),
)
def build_edl(spark, d):
    return tl.build_edl(fx.segments(spark, d), fx.visuals(spark, d))


@query(
    "build_edl_realized",
    sql(
        REALIZED + ", " + USED
        + f""", l AS (SELECT work_id, segment_id, max(ord) AS last FROM used GROUP BY 1, 2), e AS (SELECT u.work_id, n.ord AS seg_ord, u.segment_id, u.ord, u.source_id, u.start_us, u.start_us + used_us AS end_us,
     n.end_frame, n.end_frame - n.fc + {hu('local_us*30', '1000000')} AS out_start_frame,
     CASE WHEN u.ord = l.last THEN n.end_frame ELSE n.end_frame - n.fc + {hu('(local_us + used_us)*30', '1000000')} END AS out_end_frame
     FROM used u JOIN rt n ON n.work_id = u.work_id AND n.segment_id = u.segment_id JOIN l ON l.work_id = u.work_id AND l.segment_id = u.segment_id)
     SELECT * EXCLUDE (end_frame), out_end_frame <= out_start_frame OR out_end_frame > end_frame AS out_of_range FROM e""",
        "segments", "visuals",
    ),
)
def build_edl_realized(spark, d):
    s, v = fx.segments(spark, d), fx.visuals(spark, d)
    return tl.build_edl(s, v, tl.realized_timeline(s, v, facts(spark, d), 30, 1)[0], 30, 1)


HL = """hl AS (SELECT DISTINCT work_id, 'h' || unit_id AS highlight_id, source_id, start_us + 200000 AS a, end_us + 3000000 AS b FROM visuals WHERE ord % 2 = 0)"""


@query(
    "first_use",
    sql(
        USED + ", " + HL
        + """ SELECT u.work_id, u.segment_id, h.highlight_id, min(u.local_us + greatest(u.start_us, a) - u.start_us) AS offset_us
     FROM used u JOIN hl h ON h.work_id = u.work_id AND h.source_id = u.source_id AND a < u.start_us + used_us AND u.start_us < b GROUP BY 1, 2, 3""",
        "segments", "visuals",
    ),
)
def first_use(spark, d):
    v = fx.visuals(spark, d)
    h = v.where("ord % 2 = 0").select("work_id", F.concat(F.lit("h"), "unit_id").alias("highlight_id"), "source_id", (F.col("start_us") + 200_000).alias("start_us"), (F.col("end_us") + 3_000_000).alias("end_us")).distinct()
    return tl.first_use(fx.segments(spark, d), v, h)


@query(
    "place_anchored",
    sql(
        PLACED
        + """, it AS (SELECT work_id, clip_id AS item_id, CASE WHEN ord % 5 = 0 THEN NULL WHEN ord % 7 = 0 THEN 'none' ELSE clip_id END AS anchor, (gain_db + 3)*1000000 AS offset_us, end_us - start_us AS len_us FROM clips),
     w AS (SELECT work_id, max(out_end_us) AS work_us FROM timeline GROUP BY 1),
     p AS (SELECT it.*, t.out_start_us AS anchor_at, w.work_us, CASE WHEN anchor IS NULL THEN 0 ELSE t.out_start_us END + offset_us AS s FROM it LEFT JOIN timeline t ON t.work_id = it.work_id AND t.clip_id = anchor JOIN w ON w.work_id = it.work_id)
     SELECT item_id AS entity_id, 'TRACK_ANCHOR_MISSING' AS rule_id FROM p WHERE anchor IS NOT NULL AND anchor_at IS NULL UNION ALL SELECT item_id, 'TRACK_OUTSIDE_WORK' FROM p WHERE s < 0 OR s + len_us > work_us""",
        "clips",
    ),
)
def place_anchored(spark, d):
    c = fx.clips(spark, d)
    anchor = F.when(F.col("ord") % 5 == 0, F.lit(None)).when(F.col("ord") % 7 == 0, F.lit("none")).otherwise(F.col("clip_id"))
    items = c.select("work_id", F.col("clip_id").alias("item_id"), anchor.alias("anchor_clip_id"), ((F.col("gain_db") + 3) * 1_000_000).alias("offset_us"), (F.col("end_us") - F.col("start_us")).alias("len_us"))
    return tl.place_anchored(items, tl.place_clips(c), "track")[1].select("entity_id", "rule_id")


@query(
    "fit_voice",
    sql(
        f"""v AS (SELECT segment_id, planned_us, voice_us AS raw_us, voice_us*1000 >= planned_us*950 AND voice_us*1000 <= planned_us*1080 AS fitted FROM segments WHERE voice_us > 0)
     SELECT segment_id, fitted, CASE WHEN fitted THEN planned_us ELSE raw_us END AS audio_us,
     CASE WHEN fitted THEN {he('1000000*planned_us', 'raw_us')} ELSE 1000000 END AS word_start_us FROM v""",
        "segments",
    ),
)
def fit_voice(spark, d):
    s = fx.segments(spark, d).where("voice_us > 0").select("segment_id", "planned_us", F.col("voice_us").alias("raw_us"))
    s = s.withColumn("words", F.array(F.struct(F.lit(1_000_000).cast("bigint").alias("start_us"), F.lit(40_000).cast("bigint").alias("dur_us"))))
    return tl.fit_voice(s).select("segment_id", "fitted", "audio_us", F.col("words")[0]["start_us"].alias("word_start_us"))


@query(
    "fade_samples",
    sql(
        f"""f AS (SELECT clip_id, end_us - start_us + 4 AS len, CAST(ord*370001 AS BIGINT) AS fi, CASE WHEN ord % 3 = 0 THEN CAST(5 AS BIGINT) ELSE 910003 END AS fo FROM clips),
     g AS (SELECT *, {he('len*48000', '1000000')} AS samples, {he('fi*48000', '1000000')} AS fade_in_samples, {he('fo*48000', '1000000')} AS fade_out_samples FROM f)
     SELECT clip_id, samples, fade_in_samples, fade_out_samples, samples*1000000 - len*48000 AS rest,
     CASE WHEN fi + fo > len THEN 'FADES_EXCEED_INTERVAL' WHEN samples <= 0 OR fade_in_samples + fade_out_samples > samples THEN 'SAMPLE_QUANTIZATION_INVALID'
      WHEN (fi > 0 AND fade_in_samples = 0) OR (fo > 0 AND fade_out_samples = 0) THEN 'SUBSAMPLE_FADE' ELSE '' END AS reason FROM g""",
        "clips",
    ),
)
def fade_samples(spark, d):
    out = F.when(F.col("ord") % 3 == 0, 5).otherwise(910_003).cast("bigint")
    f = fx.clips(spark, d).select("clip_id", "start_us", (F.col("end_us") + 4).alias("end_us"), (F.col("ord") * 370_001).alias("fade_in_us"), out.alias("fade_out_us"))
    return tl.fade_samples(f).select("clip_id", "samples", "fade_in_samples", "fade_out_samples", "rest", "reason")


@query(
    "declared_offsets",
    sql(
        """r AS (SELECT clip_id, c.start_us AS ro, c.end_us - 3000000 AS fo, 1000000*c.ord AS lo, 1000000*c.ord + 5000000 AS hi, s.duration_us AS rd, s.duration_us - 2000000 AS fd FROM clips c JOIN sources s USING (source_id))
     SELECT clip_id, fo - ro AS offset_us, CASE WHEN lo < hi AND lo >= 0 AND hi <= rd AND lo - (fo - ro) >= 0 AND hi - (fo - ro) <= fd THEN 'DECLARED' ELSE 'CLOCK_COVERAGE_INVALID' END AS state FROM r""",
        "clips", "sources",
    ),
)
def declared_offsets(spark, d):
    r = fx.clips(spark, d).join(fx.sources(spark, d).select("source_id", "duration_us"), "source_id").select(
        "clip_id", F.col("start_us").alias("reference_origin_us"), (F.col("end_us") - 3_000_000).alias("follower_origin_us"), (F.col("ord") * 1_000_000).alias("cover_start_us"),
        (F.col("ord") * 1_000_000 + 5_000_000).alias("cover_end_us"), F.col("duration_us").alias("reference_us"), (F.col("duration_us") - 2_000_000).alias("follower_us"),
    )
    return tl.declare_offset(r).select("clip_id", "offset_us", "state")


@query(
    "gain_windows",
    sql(
        """w AS (SELECT work_id, max(end_us) AS duration_us FROM clips GROUP BY 1),
     g AS (SELECT c.*, duration_us - 1000000 AS dur, max(end_us) OVER (PARTITION BY c.work_id ORDER BY start_us, clip_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM clips c JOIN w USING (work_id))
     SELECT clip_id AS entity_id, 'OVERLAPPING_GAIN_WINDOWS' AS rule_id FROM g WHERE start_us < reach UNION ALL SELECT clip_id, 'SOURCE_RANGE_INVALID' FROM g WHERE end_us > dur + 1""",
        "clips",
    ),
)
def gain_windows(spark, d):
    c = fx.clips(spark, d)
    w = c.groupBy("work_id").agg((F.max("end_us") - 1_000_000).alias("duration_us")).withColumn("base_gain_db", F.lit(-3))
    g = c.select("work_id", F.col("clip_id").alias("window_id"), "start_us", "end_us", "gain_db")
    return tl.gain_windows(g, w)[1].select("entity_id", "rule_id")


@query(
    "placed_tracks",
    sql(
        f"""w AS (SELECT work_id, max(end_us) AS duration_us FROM clips GROUP BY 1), t AS (SELECT c.*, start_us + 333 + ord AS out_us, duration_us FROM clips c JOIN w USING (work_id))
     SELECT clip_id AS track_id, {he('(out_us * 48000)', '1000000')} AS out_start_sample, out_us + end_us - start_us > duration_us + 1 AS exceeds_picture FROM t""",
        "clips",
    ),
)
def placed_tracks(spark, d):
    c = fx.clips(spark, d)
    w = c.groupBy("work_id").agg(F.max("end_us").alias("duration_us"))
    t = c.select("work_id", F.col("clip_id").alias("track_id"), "start_us", "end_us", (F.col("start_us") + 333 + F.col("ord")).alias("out_start_us"))
    return tl.place_tracks(t, w, 48_000).select("track_id", "out_start_sample", "exceeds_picture")


@query(
    "burn_list",
    sql(
        f"""c AS (SELECT source_id, ord, cue_id, text, start_us, CASE WHEN ord % 3 = 2 THEN start_us + 4000 ELSE end_us + (ord % 2)*90000 END AS end_us FROM cues),
     l AS (SELECT *, lag(end_us) OVER (PARTITION BY source_id ORDER BY ord) AS p FROM c)
     SELECT cue_id AS entity_id, 'OVERLAPPING_CAPTIONS' AS rule_id FROM l WHERE start_us < coalesce(p, 0) UNION ALL SELECT cue_id, 'CUE_TOO_SHORT' FROM l WHERE {he('end_us', '10000')} <= {he('start_us', '10000')}
     UNION ALL SELECT cue_id, 'CUE_TEXT_REQUIRED' FROM l WHERE trim(text) = '' UNION ALL SELECT cue_id, 'CONTROL_CHARACTERS_UNSUPPORTED' FROM l WHERE regexp_matches(text, '[{{}}\\\\\\r]')""",
        "cues",
    ),
)
def burn_list(spark, d):
    end = F.when(F.col("ord") % 3 == 2, F.col("start_us") + 4_000).otherwise(F.col("end_us") + (F.col("ord") % 2) * 90_000)
    return tl.check_burn_list(fx.cues(spark, d).withColumn("end_us", end), ["source_id"]).select("entity_id", "rule_id")


ATT = """o AS (SELECT work_id, segment_id FROM segments WHERE mode = 'original'), v AS (SELECT v.* FROM visuals v JOIN o USING (work_id, segment_id))"""


@query("attached_cues", sql(ATT + " SELECT DISTINCT v.work_id, v.segment_id, v.source_id, c.cue_id FROM v JOIN cues c ON c.source_id = v.source_id AND c.start_us < v.end_us AND v.start_us < c.end_us", "segments", "visuals", "cues"))
def attached_cues(spark, d):
    known = fx.sources(spark, d).select("source_id", (F.col("ord") % 4 != 0).alias("current"))
    return tl.attach_cues(fx.segments(spark, d), fx.visuals(spark, d), fx.cues(spark, d), known)[0]


@query(
    "cues_verified",
    sql(
        ATT + """, k AS (SELECT v.work_id, v.segment_id, bool_and(coalesce(s.ord % 4 <> 0, false)) AS ok FROM v LEFT JOIN sources s USING (source_id) GROUP BY 1, 2)
     SELECT o.work_id, o.segment_id, coalesce(ok, false) AS cues_verified FROM o LEFT JOIN k USING (work_id, segment_id)""",
        "segments", "visuals", "sources",
    ),
)
def cues_verified(spark, d):
    known = fx.sources(spark, d).select("source_id", (F.col("ord") % 4 != 0).alias("current"))
    return tl.attach_cues(fx.segments(spark, d), fx.visuals(spark, d), fx.cues(spark, d), known)[1]


PROJ = (
    NOMINAL + ", " + USED
    + """, e AS (SELECT u.work_id, n.ord AS seg_ord, u.segment_id, u.ord, u.source_id, u.start_us, used_us AS len_us, n.out_end_us - n.dur_us + local_us AS out_start_us, n.mode
     FROM used u JOIN nominal n ON n.work_id = u.work_id AND n.segment_id = u.segment_id),
  items AS (SELECT 'video' AS track, work_id, segment_id, seg_ord, ord, source_id, start_us, out_start_us, len_us, CAST(NULL AS BIGINT) AS rate FROM e
   UNION ALL SELECT 'original', e.work_id, segment_id, seg_ord, e.ord, e.source_id, start_us, out_start_us, len_us, CASE WHEN s.ord % 6 = 0 THEN 44100 ELSE 48000 END FROM e JOIN sources s ON s.source_id = e.source_id WHERE mode = 'original' AND has_audio
   UNION ALL SELECT 'narration', work_id, segment_id, ord, 0, 'narration:' || segment_id, 0, out_end_us - dur_us, voice_us, 48000 FROM nominal WHERE mode = 'voiceover' AND voice_us > 0)"""
)


def _projection(spark, d):
    f = fx.sources(spark, d).select("source_id", "has_audio", F.when(F.col("ord") % 6 == 0, 44100).otherwise(48000).cast("bigint").alias("sample_rate"))
    return tl.cut_projection(fx.segments(spark, d), fx.visuals(spark, d), f, 25, 1)


query("cut_projection", sql(PROJ + " SELECT * FROM items", "segments", "visuals", "sources"))(lambda s, d: _projection(s, d)[0])
query(
    "cut_alignment",
    sql(
        PROJ
        + """ SELECT segment_id || '/' || ord AS seg, track, 'UNALIGNED_OUTPUT_FRAME' AS rule_id FROM items WHERE track = 'video' AND out_start_us*25 % 1000000 <> 0
     UNION ALL SELECT segment_id || '/' || ord, track, 'UNALIGNED_SOURCE_FRAME' FROM items WHERE track = 'video' AND (start_us*25 % 1000000 <> 0 OR len_us*25 % 1000000 <> 0)
     UNION ALL SELECT segment_id || '/' || ord, track, 'UNALIGNED_AUDIO_SAMPLE' FROM items WHERE track <> 'video' AND (start_us*rate % 1000000 <> 0 OR len_us*rate % 1000000 <> 0 OR out_start_us*rate % 1000000 <> 0)""",
        "segments", "visuals", "sources",
    ),
)(lambda s, d: _projection(s, d)[1].select(F.split("entity_id", "/")[0].alias("track"), F.concat_ws("/", F.split("entity_id", "/")[1], F.split("entity_id", "/")[2]).alias("seg"), "rule_id"))
