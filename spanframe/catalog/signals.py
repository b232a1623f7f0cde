"""Queries of the scene and signal operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanframe import fixtures as fx
from spanframe.catalog.cte import sql
from spanframe.catalog.registry import query
from spanframe.catalog.timeline import he
from spanframe.operators import signals as sg
from spanframe.plans.ordered import by_rows, scan

SHOTS = """sh0 AS (SELECT source AS source_id, doc_id AS ord, greatest(500000, n_chars*2500) AS len FROM documents),
 shots AS (SELECT source_id, ord, CAST(sum(len) OVER (PARTITION BY source_id ORDER BY ord) AS BIGINT) - len AS start_us, CAST(sum(len) OVER (PARTITION BY source_id ORDER BY ord) AS BIGINT) AS end_us FROM sh0),
 scues AS (SELECT s.source_id, s.ord, s.start_us + (end_us - start_us) // 4 AS start_us, end_us, lang || s.ord AS text FROM shots s JOIN documents ON doc_id = s.ord)"""


def shots(spark, d):
    s = fx.table(spark, d, "documents").select(F.col("source").alias("source_id"), F.col("doc_id").alias("ord"), F.greatest(F.lit(500_000), F.col("n_chars") * 2500).cast("bigint").alias("len"), "lang")
    s = scan(s, ["source_id"], ["ord"], by_rows("ord"), sums={"end_us": F.col("len")})
    return s.withColumn("start_us", F.col("end_us") - F.col("len")).drop("len")


def shot_cues(spark, d):
    s = shots(spark, d)
    return s.select("source_id", "ord", (F.col("start_us") + F.expr("(end_us - start_us) div 4")).alias("start_us"), "end_us", F.concat("lang", "ord").alias("text"))


query(
    "fixed_windows",
    sql("SELECT source_id, i + 1 AS ord, i*16000000 AS start_us, least(duration_us, (i + 1)*16000000) AS end_us FROM (SELECT *, unnest(range((duration_us + 15999999) // 16000000)) AS i FROM sources)", "sources"),
)(lambda s, d: sg.fixed_windows(fx.sources(s, d), 16_000_000))

SPLIT = (
    SHOTS
    + f""", sn AS (SELECT *, greatest(1, (end_us - start_us + 15999999) // 16000000) AS n FROM shots), sp AS (SELECT *, unnest(range(n)) AS part FROM sn),
  split AS (SELECT source_id, ord, part, start_us + {he('(end_us - start_us)*part', 'n')} AS start_us, start_us + {he('(end_us - start_us)*(part + 1)', 'n')} AS end_us FROM sp)"""
)
query("split_long", "WITH " + SPLIT + " SELECT * FROM split")(lambda s, d: sg.split_long(shots(s, d), 16_000_000))

PACK = (
    SPLIT
    + """, o AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY start_us, ord, part) AS n FROM split),
  w(source_id, n, unit, u0) AS (SELECT source_id, n, CAST(1 AS BIGINT), start_us FROM o WHERE n = 1
   UNION ALL SELECT o.source_id, o.n, CASE WHEN o.end_us - w.u0 > 16000000 THEN w.unit + 1 ELSE w.unit END, CASE WHEN o.end_us - w.u0 > 16000000 THEN o.start_us ELSE w.u0 END FROM w JOIN o ON o.source_id = w.source_id AND o.n = w.n + 1),
  g AS (SELECT w.source_id, unit, min(start_us) AS start_us, max(end_us) AS end_us, count(*) AS n_shots FROM w JOIN o ON o.source_id = w.source_id AND o.n = w.n GROUP BY 1, 2),
  l AS (SELECT *, lag(start_us) OVER (PARTITION BY source_id ORDER BY unit) AS p0, max(unit) OVER (PARTITION BY source_id) AS last FROM g),
  f AS (SELECT *, CASE WHEN unit = last AND unit > 1 AND end_us - start_us < 4000000 AND end_us - p0 <= 16000000 THEN unit - 1 ELSE unit END AS u2 FROM l),
  packed AS (SELECT source_id, u2 AS unit, min(start_us) AS start_us, max(end_us) AS end_us, CAST(sum(n_shots) AS BIGINT) AS n_shots FROM f GROUP BY 1, 2)"""
)


@query("pack_units", "WITH RECURSIVE " + PACK + " SELECT * FROM packed")
def pack_units(spark, d):
    return sg.pack_units(shots(spark, d), 4_000_000, 16_000_000)


@query(
    "scene_index",
    "WITH RECURSIVE " + PACK + """, t AS (SELECT p.source_id, p.unit, string_agg(c.text, ' ' ORDER BY c.ord) AS text, CAST(sum(least(p.end_us, c.end_us) - greatest(p.start_us, c.start_us)) AS BIGINT) AS speech_us, count(*) AS n_cues
     FROM packed p JOIN scues c ON c.source_id = p.source_id AND c.start_us < p.end_us AND p.start_us < c.end_us GROUP BY 1, 2),
    q AS (SELECT p.source_id, p.unit, count(*) AS n, bool_or(s.start_us < p.start_us - 1 OR s.end_us > p.end_us + 1) AS spill FROM packed p JOIN shots s ON s.source_id = p.source_id AND s.start_us < p.end_us AND p.start_us < s.end_us GROUP BY 1, 2)
    SELECT p.source_id, p.unit, p.start_us, p.end_us, coalesce(text, '') AS text, coalesce(speech_us, 0) AS speech_us, coalesce(n_cues, 0) AS n_cues, round(least(1, coalesce(speech_us, 0) / greatest(1000, p.end_us - p.start_us)), 6) AS speech_density,
     round(least(1, n_shots*1000000/greatest(1000, p.end_us - p.start_us)/1.5), 6) AS shot_density, coalesce(q.n, 0) AS n_continuity, coalesce(spill, false) AS window_only
    FROM packed p LEFT JOIN t ON t.source_id = p.source_id AND t.unit = p.unit LEFT JOIN q ON q.source_id = p.source_id AND q.unit = p.unit""",
)
def scene_index(spark, d):
    return sg.scene_index(sg.pack_units(shots(spark, d), 4_000_000, 16_000_000), shot_cues(spark, d), shots(spark, d))


@query(
    "sample_times",
    sql(
        f"""u AS (SELECT unit_id, start_us, end_us, end_us - start_us AS len, unnest(range(3)) AS i FROM units), m AS (SELECT *, least(200000, {he('len', '20')}) AS mg FROM u)
     SELECT unit_id, i, start_us + mg + {he('(end_us - mg - start_us - mg)*(i*2 + 1)', '6')} AS t_us FROM m""",
        "units",
    ),
)
def sample_times(spark, d):
    return sg.sample_times(fx.units(spark, d).select("unit_id", "start_us", "end_us"), 3).select("unit_id", "i", "t_us")


@query(
    "signal_crossings",
    sql(
        """l AS (SELECT *, lag(t_us) OVER (PARTITION BY source_id ORDER BY t_us, row_id) AS p FROM signals)
     SELECT source_id, count(CASE WHEN p IS NOT NULL AND value >= 100 THEN 1 END) AS n_crossings, min(CASE WHEN p IS NOT NULL AND value >= 100 THEN t_us END) AS first_crossing_us, min(t_us) AS first_us, max(t_us) AS last_us, max(t_us - p) AS max_gap_us FROM l GROUP BY 1""",
        "signals",
    ),
)
def signal_crossings(spark, d):
    return sg.crossings(fx.signals(spark, d), ["source_id"], 100.0, order=["t_us", "row_id"])


@query(
    "window_energy",
    """WITH x AS (SELECT CAST(vec_id AS VARCHAR) AS source_id, CAST(unnest(embedding) AS DOUBLE) AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings)
     SELECT source_id, CAST(i // 16 AS BIGINT) AS win, count(*) AS n_samples, round(CASE WHEN avg(v*v) > 0 THEN 10*log10(avg(v*v)) END, 6) AS rms_db, round(CASE WHEN max(abs(v)) > 0 THEN 20*log10(max(abs(v))) END, 6) AS peak_db FROM x GROUP BY 1, 2""",
)
def window_energy(spark, d):
    w = sg.window_energy(fx.samples(spark, d), 16)
    return w.withColumn("rms_db", F.round("rms_db", 6)).withColumn("peak_db", F.round("peak_db", 6)).withColumn("win", F.col("win").cast("bigint"))


@query(
    "log_envelope",
    """WITH h AS (SELECT CAST(vec_id AS VARCHAR) AS source_id, embedding AS x, unnest(range((64 - 16) // 8 + 1)) AS h FROM embeddings)
     SELECT source_id, h, round(0.5*ln(greatest(list_sum(list_transform(x[h*8+1:h*8+16], lambda v: CAST(v AS DOUBLE)*CAST(v AS DOUBLE)))/16, 1e-12)), 6) AS env FROM h""",
)
def log_envelope(spark, d):
    return sg.log_envelope(fx.samples(spark, d), 16, 8).withColumn("env", F.round("env", 6))


@query(
    "motion_score",
    """WITH f AS (SELECT label, vec_id, embedding AS x, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS p FROM embeddings),
     m AS (SELECT label, CASE WHEN p IS NOT NULL THEN list_avg(list_transform(list_zip(x, p), lambda z: abs(CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE)))) END AS df FROM f)
     SELECT label, round(least(1, coalesce(avg(df), 0)*4), 6) AS motion FROM m GROUP BY 1""",
)
def motion_score(spark, d):
    f = fx.table(spark, d, "embeddings").select("label", "vec_id", F.col("embedding").alias("x"))
    return sg.motion(f, ["label"], "vec_id")


def lag_pairs(spark, d):
    v = F.col("vec_id")
    return fx.table(spark, d, "embeddings").select(v.cast("string").alias("pair_id"), F.col("embedding").alias("x"), F.slice("embedding", (v % 20 + 1).cast("int"), F.lit(32)).alias("y"))


LAG = """WITH RECURSIVE p AS (SELECT CAST(vec_id AS VARCHAR) AS pair_id, vec_id % 20 AS o, embedding AS x, embedding[vec_id % 20 + 1:vec_id % 20 + 32] AS y FROM embeddings),
 y AS (SELECT pair_id, CAST(unnest(y) AS DOUBLE) - list_sum(list_transform(y, lambda v: CAST(v AS DOUBLE)))/32 AS yv, generate_subscripts(y, 1) - 1 AS j FROM p), e AS (SELECT pair_id, sum(yv*yv) AS e FROM y GROUP BY 1),
 x AS (SELECT pair_id, CAST(unnest(x) AS DOUBLE) AS xv, generate_subscripts(x, 1) - 1 AS i FROM p), l AS (SELECT unnest(range(33)) AS lag),
 d AS (SELECT x.pair_id, lag, sum(xv*yv) AS dot, sum(xv) AS sx, sum(xv*xv) AS sxx FROM x JOIN y ON y.pair_id = x.pair_id JOIN l ON i - lag = j GROUP BY 1, 2),
 c AS (SELECT d.pair_id, lag, CASE WHEN sqrt(greatest(0, sxx - sx*sx/32)*e) > 1e-12 THEN greatest(-1, least(1, dot/sqrt(greatest(0, sxx - sx*sx/32)*e))) ELSE 0 END AS corr FROM d JOIN e ON e.pair_id = d.pair_id),
 m AS (SELECT *, abs(corr) AS sz, round(abs(corr), 9) AS mag FROM c), b AS (SELECT pair_id, arg_min(lag, (-mag, lag)) AS best_lag, max(sz) AS peak FROM m GROUP BY 1),
 f AS (SELECT m.pair_id, max(sz) AS runner FROM m JOIN b ON b.pair_id = m.pair_id AND abs(m.lag - b.best_lag) > 1 GROUP BY 1)
 SELECT b.pair_id, CAST(b.best_lag AS INTEGER) AS best_lag, round(m.corr, 6) AS correlation, round(peak - greatest(0, coalesce(runner, 0)), 6) AS peak_margin, b.best_lag IN (0, 32) AS at_edge
 FROM b JOIN m ON m.pair_id = b.pair_id AND m.lag = b.best_lag LEFT JOIN f ON f.pair_id = b.pair_id"""

query("array_lag", LAG)(lambda s, d: sg.correlate(lag_pairs(s, d)).select("pair_id", "best_lag", "correlation", "peak_margin", "at_edge"))
query("array_lag_fft", LAG)(lambda s, d: sg.correlate_fft(lag_pairs(s, d)))


@query(
    "offset_consensus",
    sql(
        """m AS (SELECT CAST(work_id AS VARCHAR) AS source_id, start_us AS f, CASE WHEN ord % 6 <> 5 THEN 1000 + ord % 3 + CASE WHEN gain_db = -10 THEN 5000 ELSE 0 END END AS o FROM clips),
     g AS (SELECT source_id, median(o) AS offset_us, max(o) - min(o) AS spread_us, max(f) - min(f) AS span_us, count(*) AS n, count(o) AS n_usable FROM m GROUP BY 1),
     i AS (SELECT *, concat_ws(',', CASE WHEN n > n_usable THEN 'WINDOW_ISSUES' END, CASE WHEN span_us < 5000000 THEN 'INSUFFICIENT_TIME_COVERAGE' END, CASE WHEN spread_us > 1000 THEN 'NONCONSTANT_OFFSET_OR_BAD_MATCH' END, CASE WHEN n_usable < n THEN 'INCOMPLETE_MEASUREMENTS' END) AS issues FROM g)
     SELECT source_id, offset_us, spread_us, span_us, n_usable, issues, CASE WHEN issues = '' THEN 'CONSISTENT' ELSE 'REVIEW_NEEDED' END AS state FROM i""",
        "clips",
    ),
)
def offset_consensus(spark, d):
    c = fx.clips(spark, d)
    o = F.when(F.col("ord") % 6 != 5, 1000 + F.col("ord") % 3 + F.when(F.col("gain_db") == -10, 5000).otherwise(0))
    m = c.select(F.col("work_id").alias("source_id"), F.col("start_us").alias("follower_us"), o.alias("offset_us"), F.when(o.isNull(), F.array(F.lit("SILENT"))).otherwise(F.array().cast("array<string>")).alias("issues"))
    return sg.offset_consensus(m, 1000, 5_000_000)


@query(
    "marker_offsets",
    sql(
        """m AS (SELECT work_id AS source_id, ord, ord*1000000 + start_us % 7 AS r, ord*1000000 - CASE WHEN gain_db = -10 AND ord > 1 THEN 2000000 ELSE 50 END AS f FROM clips),
     l AS (SELECT *, lag(r) OVER w AS pr, lag(f) OVER w AS pf FROM m WINDOW w AS (PARTITION BY source_id ORDER BY ord))
     SELECT source_id, count(*) AS n_markers, bool_and(pr IS NULL OR (r > pr AND f > pf)) AS rising, median(r - f) AS offset_us,
     CASE WHEN count(*) < 3 THEN 'THREE_MARKERS_REQUIRED' WHEN NOT bool_and(pr IS NULL OR (r > pr AND f > pf)) THEN 'MARKERS_NOT_STRICTLY_CHRONOLOGICAL' ELSE 'OK' END AS state FROM l GROUP BY 1""",
        "clips",
    ),
)
def marker_offsets(spark, d):
    off = F.when((F.col("gain_db") == -10) & (F.col("ord") > 1), 2_000_000).otherwise(50)
    m = fx.clips(spark, d).select(F.col("work_id").alias("source_id"), "ord", (F.col("ord") * 1_000_000 + F.col("start_us") % 7).alias("reference_us"), (F.col("ord") * 1_000_000 - off).alias("follower_us"))
    return sg.marker_offsets(m)


RUNS = """l AS (SELECT *, CASE WHEN value < 40 THEN 1 ELSE 0 END AS low FROM signals), p AS (SELECT *, lag(low) OVER (PARTITION BY source_id ORDER BY t_us, row_id) AS pl FROM l),
 r AS (SELECT *, sum(CASE WHEN pl IS NULL OR pl <> low THEN 1 ELSE 0 END) OVER (PARTITION BY source_id ORDER BY t_us, row_id) AS run FROM p),
 runs AS (SELECT source_id, min(t_us) AS start_us, max(t_us) AS end_us, count(*) AS n_rows FROM r WHERE low = 1 GROUP BY source_id, run HAVING max(t_us) - min(t_us) >= 3600000000)"""


def _runs(spark, d):
    return sg.runs_below(fx.signals(spark, d), ["source_id"], 40.0, 3_600_000_000, ["t_us", "row_id"])


query("signal_runs", sql(RUNS + " SELECT * FROM runs", "signals"))(_runs)


@query(
    "signal_run_ratio",
    sql(
        RUNS + """, t AS (SELECT source_id, max(t_us) - min(t_us) AS duration_us FROM signals GROUP BY 1), g AS (SELECT source_id, CAST(sum(end_us - start_us) AS BIGINT) AS run_us FROM runs GROUP BY 1)
     SELECT t.source_id, duration_us, coalesce(run_us, 0) AS run_us, round(CASE WHEN duration_us > 0 THEN coalesce(run_us, 0)/duration_us ELSE 1 END, 6) AS ratio FROM t LEFT JOIN g USING (source_id)""",
        "signals",
    ),
)
def signal_run_ratio(spark, d):
    t = fx.signals(spark, d).groupBy("source_id").agg((F.max("t_us") - F.min("t_us")).alias("duration_us"))
    return sg.run_ratio(_runs(spark, d), t, ["source_id"])
