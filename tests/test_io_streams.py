"""Readers and sinks on files, streams against their batch twins."""

import hashlib
import random
import time

from pyspark.sql import functions as F

from spanframe import fixtures as fx
from spanframe.operators import intervals as iv
from spanframe.sources import readers as rd
from spanframe.sources import sinks as sk
from spanframe.sql import register
from spanframe.streaming import streams as st

SF = "/root/testdata/sf0.001"


def test_srt_files(spark, tmp_path):
    (tmp_path / "a.srt").write_text("﻿1\r\n00:00:01,000 --> 00:00:02,5\r\n<i>Hi</i> &amp;\r\nthere\r\n\r\nx\r\n\r\n2\r\n01:02.250 --> 01:03.000\r\nsecond\r\n\r\n3\r\n00:00:05,000 --> 00:00:04,000\r\nback\r\n", encoding="utf-8")
    got = [(r.start_us, r.end_us, r.text) for r in rd.read_srt(spark, str(tmp_path / "a.srt")).orderBy("start_us").collect()]
    assert got == [(1_000_000, 2_500_000, "Hi & there"), (62_250_000, 63_000_000, "second")]
    (tmp_path / "b.srt").write_text("1\n00:00:01,000 --> 00:00:02,000\nok\n\n2\n00:61:01,000 --> 00:62:02,000\nbad\n\nnope\n")
    ok, bad = rd.read_srt_strict(spark, str(tmp_path / "b.srt"))
    assert [r.text for r in ok.collect()] == ["ok"]
    assert sorted(r.rule_id for r in bad.collect()) == ["SRT_BLOCK_INCOMPLETE", "SRT_CLOCK_OUT_OF_RANGE"]


def test_ass_headers_with_few_columns(spark):
    # the header is shorter than the columns that hold before it
    rows = spark.range(40).select(F.col("id").cast("string").alias("path"), F.concat(F.lit("[Events]\nFormat: Layer, Start, End, Style, Text\nDialogue: 0,0:00:01.00,0:00:02.00,Default,a, "), "id").alias("value"))
    got = rd.parse_ass(rows).select("path", "start_us", "text").collect()
    assert sorted((int(r.path), r.start_us, r.text) for r in got) == [(i, 1_000_000, f"a, {i}") for i in range(40)]
    measured = spark.conf.get("spanframe.skew.measure", None)
    spark.conf.set("spanframe.skew.measure", "true")
    try:
        assert rd.parse_ass(rows).count() == 40
        assert rd.parse_ass(rows).where("text like 'a%'").select("end_us").distinct().count() == 1
    finally:
        spark.conf.unset("spanframe.skew.measure") if measured is None else spark.conf.set("spanframe.skew.measure", measured)


def test_ass_file_with_commas_in_text(spark, tmp_path):
    (tmp_path / "a.ass").write_text("[Events]\nFormat: Layer, Start, End, Text\nDialogue: 0,0:00:01.00,0:00:02.50,{\\b1}a, b\\Nc\nFormat: Start, End, Text\nDialogue: 0:00:03.00,0:00:04.00,later\n")
    got = [(r.start_us, r.end_us, r.text) for r in rd.read_ass(spark, str(tmp_path / "a.ass")).orderBy("start_us").collect()]
    assert got == [(1_000_000, 2_500_000, "a, b c"), (3_000_000, 4_000_000, "later")]


def test_srt_write_and_read_back(spark, tmp_path):
    c = spark.createDataFrame([("w", f"c{i}", i * 2_000_000, i * 2_000_000 + 1_500_400, f"text {i}") for i in range(20)], "work_id string, cue_id string, start_us long, end_us long, text string")
    sk.write_srt(c, str(tmp_path / "out"))
    back = rd.read_srt(spark, str(tmp_path / "out" / "work_id=w"))
    # a line-oriented write is one block per row, so rows are read as one file text
    assert back.count() == 20 and back.agg(F.max("end_us")).first()[0] == 39_500_000


def test_interchange_round_trip(spark):
    t = spark.createDataFrame([("w", "v", "Video", "i1", "r", 0, 5, 3), ("w", "v", "Video", "i2", "r", 9, 4, 8)], "work_id string, track_id string, kind string, instance_id string, resource_id string, start_us long, duration_us long, target_start_us long")
    docs = sk.interchange_json(t).select(F.col("work_id").alias("path"), "value")
    items, ends, bad = rd.parse_interchange(docs, t.select("instance_id", "track_id"))
    assert sorted((r.instance_id, r.target_start_us) for r in items.collect()) == [("i1", 3), ("i2", 8)]
    assert ends.first().track_end_us == 12 and bad.count() == 0


def test_sources_registry(spark, tmp_path):
    (tmp_path / "x.bin").write_bytes(b"abc")
    r = rd.register_sources(spark, str(tmp_path / "*.bin"))
    row = r.first()
    assert row.bytes == 3 and row.sha256.startswith("ba7816bf")
    assert rd.verify_sources(r, r.withColumn("sha256", F.lit("x"))).first().rule_id == "SOURCE_HASH_MISMATCH"


def test_stream_reads_a_file_and_a_folder_of_part_files(spark, tmp_path):
    e = spark.read.parquet(f"{SF}/events.parquet")
    e.repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    e.write.parquet(str(tmp_path / "more_events.parquet"))
    for folder in (SF, str(tmp_path)):
        got = st.drain(st.table_stream(spark, folder, "events"), str(tmp_path / "out"))
        assert got.count() == e.count() > 0


def test_stream_sessions_equal_batch_merge(spark, tmp_path):
    e = st.table_stream(spark, SF, "events").select(F.col("user_id").cast("string").alias("source_id"), F.col("ts").cast("timestamp").alias("t"), (F.round(F.col("value") * 100).cast("long") * 600_000).alias("length_us")).where("length_us > 0")
    gap = 1_800_000_000
    got = st.drain(st.stream_sessions(e, gap), str(tmp_path)).select("source_id", F.unix_micros("start").alias("a"), (F.unix_micros("end") - gap).alias("z"))
    batch = iv.merge_spans(fx.spans(spark, SF), ["source_id"], gap - 1)
    last = fx.signals(spark, SF).agg(F.max("t_us")).first()[0]
    want = {(r.source_id, r.start_us, r.end_us) for r in batch.collect() if r.end_us + gap <= last - 600_000_000}
    rows = {(r.source_id, r.a, r.z) for r in got.collect()}
    assert want and want <= rows


def test_long_logs_are_read_in_parts(spark, tmp_path):
    rng = random.Random(1)
    for name, n in (("a", 400), ("b", 3)):
        rows = []
        for i in range(n):
            rows += [f"frame:{i} pts:1" + (f" pts_time:{i / 8}" if i % 7 else ""), f"k.x={rng.choice(['1.5', '-inf', 'nan', '2', 'bad'])}"] + [f"noise line {j}" for j in range(i % 3)] + [f"k.y={i}"] * (i % 2)
        (tmp_path / f"{name}.log").write_text("\ufeff" + "\r\n".join(rows) + "\r\n", encoding="utf-8")
    whole = rd.parse_signal_log(rd._texts(spark, str(tmp_path / "*.log")), ["k.x", "k.y"])
    want = sorted((r.path[-5], r.row, r.t_us, r.x, r.y) for r in whole.collect())
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        lines = spark.read.text(str(tmp_path / "a.log"))
        assert lines.rdd.getNumPartitions() > 10
        got = sorted((r.path[-5], r.row, r.t_us, r.x, r.y) for r in rd.read_signal_log(spark, str(tmp_path / "*.log"), ["k.x", "k.y"]).collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(want) == 403 and got == want


def test_files_are_hashed_piece_by_piece(spark, tmp_path, monkeypatch):
    body = bytes(range(256)) * 20_000
    for name, data in (("big", body), ("empty", b""), ("odd name%20", b"x")):
        (tmp_path / f"{name}.bin").write_bytes(data)
    got = {r.path.rsplit("/", 1)[1]: (r.bytes, r.sha256) for r in rd.register_sources(spark, str(tmp_path / "*.bin")).collect()}
    assert got == {"big.bin": (len(body), hashlib.sha256(body).hexdigest()), "odd name%20.bin": (1, hashlib.sha256(b"x").hexdigest())}  # Spark lists no empty files


def test_stream_budget_equals_batch_whatever_the_files(spark, tmp_path):
    rng = random.Random(4)
    rows = [(rng.choice("ab"), f"r{i}", 1_000_000_000 + i * 3600, rng.choice([1, 5, 20])) for i in range(60)]
    rows += [(b, f"z{b}", 1_000_000_000 + 100 * 86_400, 1) for b in "ab"]  # far behind: only moves the watermark
    schema = "budget_key string, request_id string, s long, amount long"
    want, used = {}, {"a": 0, "b": 0}
    for b, r, _, a in rows[:60]:
        ok = used[b] + a <= 90
        used[b] += a if ok else 0
        want[b, r] = (ok, used[b])
    for cut, seed in ((1, 0), (9, 1), (20, 2)):  # rows per file; the files of a day in any order
        folder, out = str(tmp_path / f"in{cut}"), str(tmp_path / f"out{cut}")
        parts = [rows[i : i + cut] for i in range(0, 60, cut)] if cut > 1 else [rows[:60]]
        if cut == 9:
            parts[0], parts[1] = parts[1], parts[0]
        for part in [*parts, rows[60:]]:
            mixed = random.Random(seed).sample(part, len(part))
            spark.createDataFrame(mixed, schema).coalesce(1).write.mode("append").parquet(folder)
            time.sleep(0.05)  # files are read by their times
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder).select("budget_key", "request_id", F.timestamp_seconds("s").alias("t"), "amount")
        got = {(r.budget_key, r.request_id): (r.accepted, r.reserved) for r in st.drain(st.stream_budget(stream, 90), out).collect()}
        assert got == want


def test_register_view(spark):
    s = spark.createDataFrame([("a", 0, 5), ("a", 4, 9)], "source_id string, start_us long, end_us long")
    register(spark, "isl", iv.merge_spans, s, keys=["source_id"])
    assert spark.sql("select max(end_us) m, count(*) n from isl").first() == (9, 1)
