"""Queries of the interval operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from spanframe import fixtures as fx
from spanframe.catalog.cte import sql
from spanframe.catalog.registry import query
from spanframe.operators import intervals as iv

ISLANDS = """, m AS (SELECT *, max(end_us) OVER (PARTITION BY source_id ORDER BY start_us, end_us, span_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM spans),
 g AS (SELECT *, sum(CASE WHEN reach IS NULL OR start_us > reach + {tol} THEN 1 ELSE 0 END) OVER (PARTITION BY source_id ORDER BY start_us, end_us, span_id) AS grp FROM m),
 islands AS (SELECT source_id, min(start_us) AS start_us, max(end_us) AS end_us, count(*) AS n_spans FROM g GROUP BY source_id, grp)"""


def islands_sql(body, tol=0):
    return sql(ISLANDS.format(tol=tol).lstrip(",") + " " + body, "spans")


@query(
    "merged_activity",
    islands_sql(""", h AS (SELECT source_id, start_us - lag(end_us) OVER (PARTITION BY source_id ORDER BY start_us) AS hole, end_us - start_us AS len, start_us, end_us FROM islands)
 SELECT source_id, count(*) AS n_islands, CAST(sum(len) AS BIGINT) AS active_us, min(start_us) AS first_us, max(end_us) AS last_us,
 CAST(count(CASE WHEN hole > 3600000000 THEN 1 END) AS BIGINT) AS n_long_gaps, CAST(coalesce(sum(CASE WHEN hole > 3600000000 THEN hole END), 0) AS BIGINT) AS long_gap_us
 FROM h GROUP BY source_id"""),
)
def merged_activity(spark, d):
    """Per source: merged activity, its total, and every gap longer than one hour."""
    islands = iv.merge_spans(fx.spans(spark, d), ["source_id"])
    gaps = iv.gaps_between(islands, ["source_id"]).select("source_id", (F.col("end_us") - F.col("start_us")).alias("hole"))
    long = gaps.where("hole > 3600000000").groupBy("source_id").agg(F.count(F.lit(1)).alias("n_long_gaps"), F.sum("hole").alias("long_gap_us"))
    total = islands.groupBy("source_id").agg(
        F.count(F.lit(1)).alias("n_islands"), F.sum(F.col("end_us") - F.col("start_us")).alias("active_us"),
        F.min("start_us").alias("first_us"), F.max("end_us").alias("last_us"),
    )
    return total.join(long, "source_id", "left").na.fill(0, ["n_long_gaps", "long_gap_us"])


query("merge_spans", islands_sql("SELECT * FROM islands"))(lambda s, d: iv.merge_spans(fx.spans(s, d), ["source_id"]))
query("merge_spans_tolerance", islands_sql("SELECT * FROM islands", 1_800_000_000))(
    lambda s, d: iv.merge_spans(fx.spans(s, d), ["source_id"], 1_800_000_000)
)


@query(
    "check_spans",
    sql(
        """SELECT clip_id AS entity_id, r AS rule_id FROM (SELECT c.*, s.duration_us, unnest([CASE WHEN duration_us IS NULL THEN 'UNKNOWN_SOURCE' END,
        CASE WHEN start_us < 0 THEN 'SPAN_NEGATIVE' END, CASE WHEN end_us <= start_us THEN 'SPAN_EMPTY' END, CASE WHEN end_us > duration_us + 20000 THEN 'SPAN_PAST_END' END]) AS r
        FROM clips c LEFT JOIN sources s USING (source_id)) WHERE r IS NOT NULL""",
        "clips", "sources",
    ),
)
def check_spans(spark, d):
    out = iv.check_spans(fx.clips(spark, d), fx.sources(spark, d), 20_000, "work_id", "clip_id")
    return out.select("entity_id", "rule_id")


PAIRS = """SELECT a.source_id, a.span_id, b.span_id AS b_span_id, least(a.end_us, b.end_us) - greatest(a.start_us, b.start_us) AS overlap_us,
 greatest(a.start_us, b.start_us) AS clip_start_us, least(a.end_us, b.end_us) AS clip_end_us
 FROM spans a JOIN spans b ON a.source_id = b.source_id AND a.start_us < b.end_us AND b.start_us < a.end_us WHERE a.kind = 'purchase' AND b.kind = 'error'"""


@query("span_overlap_pairs", sql(PAIRS, "spans"))
def span_overlap_pairs(spark, d):
    s = fx.spans(spark, d)
    a, b = s.where("kind = 'purchase'"), s.where("kind = 'error'")
    out = iv.overlap_join(a, b, ["source_id"], bin_us=7_200_000_000)
    return out.select(
        "source_id", "span_id", "b_span_id", "overlap_us",
        F.greatest("start_us", "b_start_us").alias("clip_start_us"), F.least("end_us", "b_end_us").alias("clip_end_us"),
    )


@query(
    "clip_spans_to_cues",
    sql(
        """SELECT c.clip_id, q.cue_id, greatest(c.start_us, q.start_us) AS clip_start_us, least(c.end_us, q.end_us) AS clip_end_us
        FROM clips c JOIN cues q ON c.source_id = q.source_id AND c.start_us < q.end_us AND q.start_us < c.end_us""",
        "clips", "cues",
    ),
)
def clip_spans_to_cues(spark, d):
    out = iv.clip_to(fx.clips(spark, d).select("source_id", "clip_id", "start_us", "end_us"), fx.cues(spark, d).select("source_id", "cue_id", "start_us", "end_us"), ["source_id"])
    return out.select("clip_id", F.col("b_cue_id").alias("cue_id"), "clip_start_us", "clip_end_us")


DAYS = """, days AS (SELECT source_id, day AS target_id, day*86400000000 AS start_us, (day+1)*86400000000 AS end_us
  FROM (SELECT DISTINCT source_id, start_us // 86400000000 AS day FROM spans)),
 parts AS (SELECT d.source_id, d.target_id, greatest(d.start_us, i.start_us) AS start_us, least(d.end_us, i.end_us) AS end_us, d.start_us AS t0, d.end_us AS t1
  FROM days d JOIN islands i ON d.source_id = i.source_id AND d.start_us < i.end_us AND i.start_us < d.end_us)"""


def _days(s):
    day = F.call_function("div", F.col("start_us"), F.lit(86_400_000_000))
    return (
        s.select("source_id", day.alias("target_id")).distinct()
        .withColumn("start_us", F.col("target_id") * 86_400_000_000).withColumn("end_us", (F.col("target_id") + 1) * 86_400_000_000)
    )


query("coverage_parts", islands_sql(DAYS + " SELECT source_id, target_id, start_us, end_us FROM parts"))(
    lambda s, d: iv.coverage(fx.spans(s, d), _days(fx.spans(s, d)), ["source_id"], bin_us=14_400_000_000)[0]
)
query(
    "coverage_gaps",
    islands_sql(
        DAYS
        + """, marks AS (SELECT source_id, target_id, start_us, end_us, 0 AS mark FROM parts UNION ALL SELECT source_id, target_id, end_us, end_us, 1 FROM days),
     h AS (SELECT m.source_id, m.target_id, coalesce(lag(m.end_us) OVER (PARTITION BY m.source_id, m.target_id ORDER BY m.start_us, m.mark), d.start_us) AS a, m.start_us AS b
      FROM marks m JOIN days d ON d.source_id = m.source_id AND d.target_id = m.target_id) SELECT source_id, target_id, a AS start_us, b AS end_us FROM h WHERE a < b"""
    ),
)(lambda s, d: iv.coverage(fx.spans(s, d), _days(fx.spans(s, d)), ["source_id"], bin_us=14_400_000_000)[1])


@query(
    "contained_spans",
    islands_sql(
        """, t AS (SELECT source_id, row_id AS target_id, t_us AS start_us, t_us + 1800000000 AS end_us FROM signals_)
     SELECT t.source_id, t.target_id, max(CASE WHEN i.source_id IS NOT NULL THEN 1 ELSE 0 END) = 1 AS contained FROM t
     LEFT JOIN islands i ON i.source_id = t.source_id AND i.start_us <= t.start_us AND t.end_us <= i.end_us GROUP BY 1, 2"""
    ).replace("signals_", "(SELECT CAST(user_id AS VARCHAR) AS source_id, epoch_us(ts) AS t_us, event_id AS row_id FROM events)"),
)
def contained_spans(spark, d):
    t = fx.signals(spark, d).select("source_id", F.col("row_id").alias("target_id"), F.col("t_us").alias("start_us"), (F.col("t_us") + 1_800_000_000).alias("end_us"))
    return iv.contained(t, fx.spans(spark, d), ["source_id"], bin_us=14_400_000_000).select("source_id", "target_id", "contained")


@query(
    "barrier_crossings",
    sql(
        """t AS (SELECT work_id, clip_id AS target_id, source_id, start_us, end_us FROM clips),
     b AS (SELECT source_id, start_us AS lo, CASE WHEN ord % 2 = 0 THEN start_us ELSE start_us + 1000000 END AS hi FROM cues)
     SELECT DISTINCT t.source_id, t.target_id, 'BARRIER' AS reason FROM t JOIN b ON t.source_id = b.source_id
     AND ((lo < hi AND t.start_us < hi AND t.end_us > lo) OR (lo = hi AND t.start_us < lo AND lo < t.end_us))
     UNION ALL SELECT t.source_id, t.target_id, 'SEVERAL_RUNS' FROM t JOIN cues r ON r.source_id = t.source_id AND r.start_us < t.end_us AND t.start_us < r.end_us
     GROUP BY 1, 2 HAVING count(*) > 1""",
        "clips", "cues",
    ),
)
def barrier_crossings(spark, d):
    t = fx.clips(spark, d).select(F.col("clip_id").alias("target_id"), "source_id", "start_us", "end_us")
    c = fx.cues(spark, d)
    b = c.select("source_id", "start_us", F.when(F.col("ord") % 2 == 0, F.col("start_us")).otherwise(F.col("start_us") + 1_000_000).alias("end_us"))
    return iv.crosses_barrier(t, b, c, ["source_id"])


@query(
    "undeclared_reuse",
    sql(
        """SELECT a.work_id, a.source_id, a.ord, count(*) AS n_earlier, min(b.ord) AS first_earlier,
     max(least(a.end_us, b.end_us) - greatest(a.start_us, b.start_us)) AS overlap_us
     FROM clips a JOIN clips b ON a.work_id = b.work_id AND a.source_id = b.source_id AND b.ord < a.ord
     AND least(a.end_us, b.end_us) - greatest(a.start_us, b.start_us) > 200000 GROUP BY 1, 2, 3""",
        "clips",
    ),
)
def undeclared_reuse(spark, d):
    return iv.find_reuse(fx.clips(spark, d), ["work_id", "source_id"], min_us=200_000)


@query(
    "lane_overlaps",
    sql(
        """SELECT source_id, span_id, prev_end_us FROM (SELECT *, lag(end_us) OVER (PARTITION BY source_id ORDER BY start_us, span_id) AS prev_end_us FROM spans)
     WHERE start_us < prev_end_us""",
        "spans",
    ),
)
def lane_overlaps(spark, d):
    return iv.check_lane(fx.spans(spark, d), ["source_id"], ["start_us", "span_id"]).select("source_id", "span_id", "prev_end_us")


@query(
    "active_partition",
    sql(
        """c AS (SELECT source_id, ord, cue_id, speaker, text, start_us, end_us + 2000000 AS end_us FROM cues),
     t AS (SELECT DISTINCT source_id, start_us AS t FROM c UNION SELECT source_id, end_us FROM c),
     p AS (SELECT source_id, t AS a, lead(t) OVER (PARTITION BY source_id ORDER BY t) AS b FROM t)
     SELECT p.source_id, a AS start_us, b AS end_us, string_agg(cue_id, ',' ORDER BY ord) AS cue_ids, sha256(string_agg(speaker || ': ' || text, chr(10) ORDER BY ord)) AS text_sha,
     count(*) AS n_active, count(DISTINCT speaker) < count(*) AS same_speaker_overlap
     FROM p JOIN c ON c.source_id = p.source_id AND c.start_us <= a AND a < c.end_us WHERE b IS NOT NULL GROUP BY 1, 2, 3""",
        "cues",
    ),
)
def active_partition(spark, d):
    c = fx.cues(spark, d).withColumn("end_us", F.col("end_us") + 2_000_000)
    out = iv.partition_active(c, ["source_id"])
    return out.withColumn("cue_ids", F.array_join("cue_ids", ",")).withColumn("text_sha", F.sha2("text", 256)).drop("text")


@query(
    "nearest_snap",
    sql(
        """n AS (SELECT c.clip_id, c.start_us, c.end_us, arg_min(q.start_us, (abs(q.start_us - c.start_us), q.ord)) AS entry, arg_min(q.end_us, (abs(q.end_us - c.end_us), q.ord)) AS exit_
     FROM clips c JOIN cues q ON c.source_id = q.source_id GROUP BY 1, 2, 3)
     SELECT c.clip_id, CASE WHEN abs(entry - c.start_us) <= 1200000 THEN entry ELSE c.start_us END AS snap_start_us,
     CASE WHEN abs(exit_ - c.end_us) <= 1200000 THEN exit_ ELSE c.end_us END AS snap_end_us,
     coalesce(abs(entry - c.start_us) <= 1200000, false) AS entry_safe, coalesce(abs(exit_ - c.end_us) <= 1200000, false) AS exit_safe
     FROM clips c LEFT JOIN n USING (clip_id)""",
        "clips", "cues",
    ),
)
def nearest_snap(spark, d):
    c = fx.clips(spark, d).select("source_id", "clip_id", "start_us", "end_us")
    return iv.snap_nearest(c, fx.cues(spark, d), ["source_id"], span_id="clip_id").drop("source_id", "start_us", "end_us")


@query(
    "dialogue_cuts",
    sql(
        """SELECT c.clip_id AS point_id, q.cue_id FROM clips c JOIN cues q ON c.source_id = q.source_id
     AND q.start_us + 20000 < c.start_us AND c.start_us < q.end_us - 20000""",
        "clips", "cues",
    ),
)
def dialogue_cuts(spark, d):
    p = fx.clips(spark, d).select("source_id", F.col("clip_id").alias("point_id"), F.col("start_us").alias("t_us"))
    return iv.cut_points(p, fx.cues(spark, d), ["source_id"]).select("point_id", "cue_id")


FRAMES = """f AS (SELECT CAST(user_id AS VARCHAR) AS source_id, epoch_us(ts) // 60000000 AS pts, max(CAST(round(value*100) AS BIGINT) // 100 + 1) AS duration FROM events GROUP BY 1, 2)"""


def frames(spark, d):
    s = fx.signals(spark, d)
    pts = F.call_function("div", F.col("t_us"), F.lit(60_000_000))
    return s.groupBy("source_id", pts.alias("pts")).agg(
        F.max(F.call_function("div", F.round(F.col("value") * 100).cast("bigint"), F.lit(100)) + 1).alias("duration")
    )


@query(
    "frame_runs",
    f"""WITH {FRAMES}, m AS (SELECT *, max(pts + duration) OVER (PARTITION BY source_id ORDER BY pts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM f),
     g AS (SELECT *, sum(CASE WHEN reach IS NULL OR pts > reach THEN 1 ELSE 0 END) OVER (PARTITION BY source_id ORDER BY pts) AS grp FROM m)
     SELECT source_id, min(pts) AS start_pts, max(pts + duration) AS end_pts, count(*) AS n_frames FROM g GROUP BY source_id, grp""",
)
def frame_runs(spark, d):
    return iv.frame_runs(frames(spark, d), ["source_id"])


@query(
    "frame_findings",
    f"""WITH {FRAMES}, x AS (SELECT source_id, pts - pts % 2 AS pts, CASE WHEN pts % 7 = 0 THEN NULL WHEN pts % 11 = 0 THEN 0 ELSE duration END AS d, CASE WHEN pts % 5 = 0 THEN duration + 1 WHEN pts % 5 = 1 THEN NULL ELSE duration END AS p FROM f)
     SELECT source_id || '@' || pts AS entity_id, 'SOURCE_TIME_DISCONTINUOUS' AS rule_id FROM x GROUP BY source_id, pts HAVING count(*) > 1
     UNION ALL SELECT source_id || '@' || pts, 'FRAME_DURATION_UNVERIFIED' FROM x WHERE d IS NULL OR d <= 0
     UNION ALL SELECT source_id || '@' || pts, 'FRAME_DURATION_CONFLICT' FROM x WHERE d <> p""",
)
def frame_findings(spark, d):
    p = F.col("pts")
    f = frames(spark, d).select(
        "source_id", (p - p % 2).alias("pts"), F.when(p % 7 == 0, None).when(p % 11 == 0, 0).otherwise(F.col("duration")).alias("duration"),
        F.when(p % 5 == 0, F.col("duration") + 1).when(p % 5 == 1, None).otherwise(F.col("duration")).alias("pkt_duration"),
    )
    return iv.check_frames(f, ["source_id"]).select("entity_id", "rule_id")


# Frames in milliseconds for 30 frames a second: on the grid with holes of a tick, every fourth source 34 ms apart, some shifted or short.
GRID = """g0 AS (SELECT CAST(user_id AS VARCHAR) AS source_id, user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events),
 gf AS (SELECT source_id, i, CASE WHEN user_id % 4 = 0 THEN 34 * i ELSE (100 * i) // 3 + CASE WHEN event_id % 11 = 0 THEN 1 ELSE 0 END END AS pts, 33 - CASE WHEN event_id % 13 = 0 THEN 12 ELSE 0 END AS duration FROM g0),
 gs AS (SELECT source_id, i, (i * 1024000 + 22050) // 44100 + CASE WHEN event_id % 11 = 0 THEN 1 ELSE 0 END AS pts, 1024 AS samples FROM g0)"""


def grid_frames(spark, d):
    e = fx.table(spark, d, "events")
    i = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return e.select(F.col("user_id").cast("string").alias("source_id"), "user_id", "event_id", i.cast("bigint").alias("i"))


def near_sql(x, u):
    return f"(({x}) // {u} + CASE WHEN 2 * (({x}) % {u}) > {u} OR 2 * (({x}) % {u}) = {u} AND (({x}) // {u}) % 2 = 1 THEN 1 ELSE 0 END)"


GOOD = f"({near_sql('x.e - x.s', 1000)} >= 1 AND abs(x.e - x.s - {near_sql('x.e - x.s', 1000)} * 1000) <= 30)"
ON = f"(abs(x.s - w.anchor - {near_sql('x.s - w.anchor', 1000)} * 1000) <= 30)"
BREAK = f"(x.s - w.reach > 30 OR x.s > w.reach AND NOT ({GOOD} AND 2 * (x.s - w.reach) < 1000 AND {ON} AND w.clean))"


@query(
    "playback_runs",
    f"""WITH RECURSIVE {GRID}, r AS (SELECT *, pts * 30 AS s, (pts + duration) * 30 AS e FROM gf),
     w(source_id, i, pts, duration, anchor, clean, reach, run) AS (SELECT source_id, i, pts, duration, s, {GOOD}, e, 1 FROM r x WHERE i = 0
     UNION ALL SELECT x.source_id, x.i, x.pts, x.duration, CASE WHEN {BREAK} THEN x.s ELSE w.anchor END, CASE WHEN {BREAK} THEN {GOOD} ELSE w.clean AND {ON} AND {GOOD} END, greatest(w.reach, x.e), w.run + CASE WHEN {BREAK} THEN 1 ELSE 0 END
     FROM w JOIN r x ON x.source_id = w.source_id AND x.i = w.i + 1)
     SELECT source_id, min(pts) AS start_pts, max(pts + duration) AS end_pts, count(*) AS n_frames FROM w GROUP BY source_id, run""",
)
def playback_runs(spark, d):
    shift = F.when(F.col("event_id") % 11 == 0, 1).otherwise(0)
    pts = F.when(F.col("user_id") % 4 == 0, 34 * F.col("i")).otherwise(F.expr("div(100 * i, 3)") + shift)
    f = grid_frames(spark, d).select("source_id", pts.alias("pts"), (33 - F.when(F.col("event_id") % 13 == 0, 12).otherwise(0)).cast("bigint").alias("duration"))
    return iv.playback_runs(f.select("*", F.lit(1).alias("tb_num"), F.lit(1000).alias("tb_den"), F.lit(30).alias("fps_num"), F.lit(1).alias("fps_den")), ["source_id"])


SPLIT = f"(x.s - w.reach > 44100 OR x.s > w.reach AND x.pts <> {near_sql('w.anchor + w.so_far * 1000', 44100)})"


@query(
    "sample_runs",
    f"""WITH RECURSIVE {GRID}, r AS (SELECT *, pts * 44100 AS s, pts * 44100 + samples * 1000 AS e FROM gs),
     w(source_id, i, pts, samples, e, anchor, so_far, reach, run) AS (SELECT source_id, i, pts, samples, e, s, samples, e, 1 FROM r WHERE i = 0
     UNION ALL SELECT x.source_id, x.i, x.pts, x.samples, x.e, CASE WHEN {SPLIT} THEN x.s ELSE w.anchor END, CASE WHEN {SPLIT} THEN 0 ELSE w.so_far END + x.samples, greatest(w.reach, x.e), w.run + CASE WHEN {SPLIT} THEN 1 ELSE 0 END
     FROM w JOIN r x ON x.source_id = w.source_id AND x.i = w.i + 1)
     SELECT source_id, min(pts) AS start_pts, CAST(sum(samples) AS BIGINT) AS samples, max(e) AS end_units, count(*) AS n_blocks FROM w GROUP BY source_id, run""",
)
def sample_runs(spark, d):
    pts = F.expr("div(i * 1024000 + 22050, 44100)") + F.when(F.col("event_id") % 11 == 0, 1).otherwise(0)
    f = grid_frames(spark, d).select("source_id", pts.alias("pts"), F.lit(1024).cast("bigint").alias("samples"))
    return iv.sample_runs(f.select("*", F.lit(44100).alias("rate"), F.lit(1).alias("tb_num"), F.lit(1000).alias("tb_den")), ["source_id"])


@query("stitched_windows", islands_sql("SELECT source_id, start_us, end_us FROM islands"))
def stitched_windows(spark, d):
    """Spans observed in overlapping 12 h windows are stitched back to the same union."""
    s = fx.spans(spark, d)
    w = F.explode(F.sequence(F.expr("start_us div 43200000000"), F.expr("end_us div 43200000000")))
    obs = s.withColumn("win", w).withColumn("lo", F.greatest("start_us", F.col("win") * 43_200_000_000 - 3_600_000_000))
    obs = obs.withColumn("hi", F.least("end_us", (F.col("win") + 1) * 43_200_000_000)).where("hi > lo")
    obs = obs.select("source_id", F.col("lo").alias("start_us"), F.col("hi").alias("end_us"), F.lit("v:0").alias("selector"))
    return iv.stitch_windows(obs, ["source_id"], ["selector"])[0].select("source_id", "start_us", "end_us")


RECON = """o AS (SELECT l_partkey AS k, l_suppkey % 4 AS a, l_quantity > 25 AS b FROM lineitem), s AS (SELECT k, a, b, count(*) AS n_obs FROM o GROUP BY 1, 2, 3),
 n AS (SELECT k, count(*) AS kinds FROM s GROUP BY 1)"""


def _obs(spark, d):
    return fx.table(spark, d, "lineitem").select(F.col("l_partkey").alias("k"), (F.col("l_suppkey") % 4).alias("a"), (F.col("l_quantity") > 25).alias("b"))


query("reconcile_agreed", f"WITH {RECON} SELECT s.* FROM s JOIN n USING (k) WHERE kinds = 1")(lambda s, d: iv.reconcile(_obs(s, d), ["k"], ["a", "b"])[0])
query("reconcile_conflicts", f"WITH {RECON} SELECT s.* FROM s JOIN n USING (k) WHERE kinds > 1")(lambda s, d: iv.reconcile(_obs(s, d), ["k"], ["a", "b"])[1])

EDGES = """e AS (SELECT DISTINCT o_orderkey AS src, o_orderkey + 1 + o_custkey % 2 AS dst FROM orders WHERE o_orderkey % 13 <> 0 AND o_orderkey + 1 + o_custkey % 2 IN (SELECT o_orderkey FROM orders)),
 d AS (SELECT src, dst, count(*) OVER (PARTITION BY src) AS n_out, count(*) OVER (PARTITION BY dst) AS n_in FROM e)"""


def _chains(spark, d):
    o = fx.table(spark, d, "orders")
    e = o.where("o_orderkey % 13 <> 0").select(F.col("o_orderkey").alias("src"), (F.col("o_orderkey") + 1 + F.col("o_custkey") % 2).alias("dst"))
    return iv.chains(o.select(F.col("o_orderkey").alias("id")), e)


query(
    "adjacency_chains",
    f"""WITH RECURSIVE {EDGES}, good AS (SELECT src, dst FROM d WHERE n_out = 1 AND n_in = 1),
     walk AS (SELECT o_orderkey AS chain_id, o_orderkey AS id, 0 AS pos FROM orders WHERE o_orderkey NOT IN (SELECT dst FROM good)
      UNION ALL SELECT chain_id, dst, pos + 1 FROM walk JOIN good ON src = id) SELECT chain_id, id, pos FROM walk""",
)(lambda s, d: _chains(s, d)[0])
query("adjacency_conflicts", f"WITH {EDGES} SELECT src, dst FROM d WHERE n_out > 1 OR n_in > 1")(lambda s, d: _chains(s, d)[1])


@query(
    "review_cover",
    sql(
        """w AS (SELECT source_id AS work_id, max(end_us) AS duration_us FROM cues GROUP BY 1),
     r AS (SELECT source_id AS work_id, cue_id AS range_id, start_us, end_us - CASE WHEN ord = 3 AND length(text) % 3 = 0 THEN 900000 ELSE 0 END AS end_us FROM cues),
     m AS (SELECT *, max(end_us) OVER (PARTITION BY work_id ORDER BY start_us, end_us, range_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM r),
     g AS (SELECT m.work_id, bool_or(start_us > coalesce(reach, 0) + 50000 OR end_us <= start_us OR end_us > duration_us + 50000) AS bad, max(end_us) AS reach_us FROM m JOIN w USING (work_id) GROUP BY 1)
     SELECT work_id, reach_us, NOT bad AND reach_us >= duration_us - 50000 AS checked FROM w LEFT JOIN g USING (work_id)""",
        "cues",
    ),
)
def review_cover(spark, d):
    c = fx.cues(spark, d)
    w = c.groupBy(F.col("source_id").alias("work_id")).agg(F.max("end_us").alias("duration_us"))
    short = F.when((F.col("ord") == 3) & (F.length("text") % 3 == 0), 900_000).otherwise(0)
    r = c.select(F.col("source_id").alias("work_id"), F.col("cue_id").alias("range_id"), "start_us", (F.col("end_us") - short).alias("end_us"))
    return iv.review_cover(r, w)


@query(
    "constant_rate",
    sql(
        """f AS (SELECT work_id, ord, (2*(ord-1)*1000000*1001 + 30000) // 60000 + CASE WHEN gain_db % 7 = 0 AND ord > 1 THEN 40 ELSE 0 END AS t_us FROM clips)
     SELECT work_id, t_us, ord - 1 AS index FROM f WHERE abs(t_us*30000 - (ord-1)*1000000*1001) >= 300000""",
        "clips",
    ),
)
def constant_rate(spark, d):
    t = F.expr("(2*(ord-1)*1000000*1001 + 30000) div 60000")
    bump = F.when((F.col("gain_db") % 7 == 0) & (F.col("ord") > 1), 40).otherwise(0)
    f = fx.clips(spark, d).select("work_id", (t + bump).alias("t_us"))
    return iv.check_constant_rate(f, ["work_id"], 30000, 1001, block_us=1_000_000)


@query(
    "timed_rows_cover",
    sql(
        """r AS (SELECT source_id, t_us, max(CASE WHEN row_id % 3 = 0 THEN NULL ELSE CAST(round(value*100) AS BIGINT)*100000 END) AS dur FROM signals GROUP BY 1, 2),
     e AS (SELECT source_id, t_us AS s, CASE WHEN dur > 0 THEN t_us + dur ELSE lead(t_us) OVER (PARTITION BY source_id ORDER BY t_us) END AS e FROM r),
     m AS (SELECT *, max(e) OVER (PARTITION BY source_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM e WHERE e > s),
     g AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY source_id ORDER BY s) AS grp FROM m)
     SELECT source_id, min(s) AS start_us, max(e) AS end_us, count(*) AS n_spans FROM g GROUP BY source_id, grp""",
        "signals",
    ),
)
def timed_rows_cover(spark, d):
    s = fx.signals(spark, d)
    dur = F.when(F.col("row_id") % 3 != 0, F.round(F.col("value") * 100).cast("bigint") * 100_000)
    r = s.groupBy("source_id", "t_us").agg(F.max(dur).alias("dur_us"))
    return iv.timed_rows_to_spans(r, ["source_id"])
