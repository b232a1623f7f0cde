"""Streaming twins of the batch operators.

Inputs are streaming DataFrames; the functions only add transformations, so the caller
picks source, sink, trigger and checkpoint.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from spanframe.operators.timeline import map_cues
from spanframe.plans.bins import BIN_US


def stream_energy(signals: DataFrame, width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """ST1: energy per source and tumbling window; rows behind the watermark are dropped.

    ``signals``: source_id, t (timestamp), value.
    """
    g = signals.withWatermark("t", delay).groupBy("source_id", F.window("t", width).alias("w"))
    g = g.agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.col("value") * F.col("value")).alias("energy"), F.max(F.abs("value")).alias("peak"))
    return g.select("source_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n_rows", F.sqrt(F.col("energy") / F.col("n_rows")).alias("rms"), "peak")


def stream_sessions(spans: DataFrame, gap_us: int, delay: str = "10 minutes") -> DataFrame:
    """ST2: activity sessions: spans of a source that are less than ``gap_us`` apart.

    ``spans``: source_id, t (start timestamp), length_us.  A session ends ``gap_us`` after
    its last span.
    """
    hold = F.concat(((F.col("length_us") + gap_us)).cast("string"), F.lit(" microseconds"))
    g = spans.withWatermark("t", delay).groupBy("source_id", F.session_window("t", hold).alias("s"))
    return g.agg(F.count(F.lit(1)).alias("n_spans")).select("source_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n_spans")


BUDGET_ROWS = "budget_key string, request_id string, accepted boolean, reserved bigint"
BUDGET_STATE = "used bigint, t array<bigint>, id array<string>, amount array<bigint>"


def stream_budget(requests: DataFrame, limit: int, delay: str = "1 day") -> DataFrame:
    """ST3: reservations against a budget in order of event time, then request id.

    ``requests``: budget_key, request_id, t (timestamp), amount.  A request waits until the
    watermark passes its time, so the order of files and the cut of micro-batches change
    nothing; what is still open at the end waits on.  A request id repeated within the
    watermark counts once; a request over the rest of the budget is refused
    and changes nothing.  The state of a budget is what it has used and the requests of one delay.
    """
    once = requests.withWatermark("t", delay).dropDuplicatesWithinWatermark(["budget_key", "request_id"])

    def fold(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        used, *kept = state.get if state.exists else (0, [], [], [])
        waiting = list(zip(*kept, strict=True))
        for rows in batches:
            waiting += zip(rows["t"].astype("datetime64[us]").astype("int64"), rows["request_id"], rows["amount"], strict=True)
        waiting.sort(key=lambda r: (r[0], r[1]))
        passed, out = state.getCurrentWatermarkMs() * 1000, []
        due = [r for r in waiting if r[0] <= passed]
        for _, request, amount in due:
            ok = used + amount <= limit
            used += int(amount) if ok else 0
            out.append((key[0], request, ok, used))
        waiting = waiting[len(due) :]
        columns = [list(c) for c in zip(*waiting, strict=True)] or [[], [], []]
        state.update((int(used), [int(t) for t in columns[0]], columns[1], [int(a) for a in columns[2]]))
        if waiting:
            state.setTimeoutTimestamp(max(-(-int(waiting[0][0]) // 1000), passed // 1000 + 1))
        yield pd.DataFrame(out, columns=["budget_key", "request_id", "accepted", "reserved"])

    return once.groupBy("budget_key").applyInPandasWithState(fold, BUDGET_ROWS, BUDGET_STATE, "append", GroupStateTimeout.EventTimeTimeout)


def stream_map_cues(cues: DataFrame, timeline: DataFrame, bin_us: int = BIN_US) -> DataFrame:
    """ST4: a live cue stream mapped onto static timelines (stream-static join on bins)."""
    return map_cues(cues, timeline, "clip", bin_us)[0]


def table_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table of a folder, a file or a folder of part files, as a file stream.

    The path is a pattern that only the table matches: a file stream refuses the plain path of a file.
    """
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{folder}/{name}.parque[t]")


def drain(stream: DataFrame, root: str) -> DataFrame:
    """Run a stream over everything available into a new Parquet folder and read it.

    ``root`` is a shared folder; each call writes below a fresh name.
    """
    out = f"{root.rstrip('/')}/stream-{uuid.uuid4().hex}"
    q = (
        stream.writeStream.format("parquet").option("path", f"{out}/data").option("checkpointLocation", f"{out}/checkpoint")
        .outputMode("append").trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{out}/data")
