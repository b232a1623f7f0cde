"""Queries of the streaming twins: file streams drained into a shared folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanframe import fixtures as fx
from spanframe.catalog.cte import sql
from spanframe.catalog.registry import query
from spanframe.catalog.timeline import MAPPED
from spanframe.operators import timeline as tl
from spanframe.plans.rounds import shared_folder
from spanframe.streaming import streams as st


def _events(spark, d):
    e = st.table_stream(spark, d, "events")
    return e.select(F.col("user_id").cast("string").alias("source_id"), F.col("ts").cast("timestamp").alias("t"), "value", F.col("event_id"))


@query(
    "stream_energy",
    """WITH g AS (SELECT CAST(user_id AS VARCHAR) AS source_id, epoch_us(ts) // 21600000000 AS w, count(*) AS n_rows, sqrt(sum(value*value)/count(*)) AS rms, max(abs(value)) AS peak FROM events GROUP BY 1, 2)
     SELECT source_id, w*21600000000 AS start_us, n_rows, round(rms, 6) AS rms, peak FROM g WHERE (w + 1)*21600000000 <= (SELECT max(epoch_us(ts)) FROM events) - 600000000""",
)
def stream_energy(spark, d):
    out = st.drain(st.stream_energy(_events(spark, d), "6 hours", "10 minutes"), shared_folder(spark))
    return out.select("source_id", F.unix_micros("start").alias("start_us"), "n_rows", F.round("rms", 6).alias("rms"), "peak")


@query(
    "stream_sessions",
    """WITH e AS (SELECT CAST(user_id AS VARCHAR) AS source_id, epoch_us(ts) AS t, epoch_us(ts) + CAST(round(value * 100) AS BIGINT) * 600000 + 1800000000 AS upto, event_id FROM events WHERE round(value * 100) > 0),
     m AS (SELECT *, max(upto) OVER (PARTITION BY source_id ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM e),
     g AS (SELECT *, sum(CASE WHEN reach IS NULL OR t >= reach THEN 1 ELSE 0 END) OVER (PARTITION BY source_id ORDER BY t, event_id) AS s FROM m)
     SELECT source_id, min(t) AS start_us, max(upto) AS end_us, count(*) AS n_spans FROM g GROUP BY source_id, s HAVING max(upto) <= (SELECT max(t) FROM e) - 600000000""",
)
def stream_sessions(spark, d):
    e = _events(spark, d).select("source_id", "t", (F.round(F.col("value") * 100).cast("bigint") * 600_000).alias("length_us")).where("length_us > 0")
    out = st.drain(st.stream_sessions(e, 1_800_000_000), shared_folder(spark))
    return out.select("source_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n_spans")


@query(
    "stream_budget",
    """WITH RECURSIVE r AS (SELECT o_custkey AS b, o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, CAST(o_orderkey AS VARCHAR)) AS seq, CAST(round(o_totalprice) AS BIGINT) AS amt
      FROM orders WHERE o_orderdate <= (SELECT max(o_orderdate) FROM orders) - INTERVAL 1 DAY),
     w(b, seq, used, id, ok) AS (SELECT DISTINCT b, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(NULL AS BIGINT), false FROM r UNION ALL SELECT w.b, r.seq, CASE WHEN used + amt <= 900000 THEN used + amt ELSE used END, r.id, used + amt <= 900000 FROM w JOIN r ON r.b = w.b AND r.seq = w.seq + 1)
     SELECT CAST(b AS VARCHAR) AS budget_key, CAST(id AS VARCHAR) AS request_id, ok AS accepted, used AS reserved FROM w WHERE id IS NOT NULL""",
)
def stream_budget(spark, d):
    o = st.table_stream(spark, d, "orders")
    r = o.select(F.col("o_custkey").cast("string").alias("budget_key"), F.col("o_orderkey").cast("string").alias("request_id"), F.col("o_orderdate").cast("timestamp").alias("t"), F.round("o_totalprice").cast("bigint").alias("amount"))
    return st.drain(st.stream_budget(r, 900_000), shared_folder(spark))


@query("stream_map_cues", sql(MAPPED + " SELECT work_id, clip_id, cue_id, start_us, end_us, partial FROM q WHERE start_us < end_us", "clips", "cues"))
def stream_map_cues(spark, d):
    t = tl.place_clips(fx.clips(spark, d))
    at = fx.cues(spark, d).select("cue_id", "start_us", "end_us")
    c = st.table_stream(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("source_id"), F.concat_ws(":", "conv_id", "turn").alias("cue_id"), "text").join(at, "cue_id")
    return st.drain(st.stream_map_cues(c, t), shared_folder(spark)).drop("text")
