"""Queries of readers, sinks and the SQL surface, over texts derived from the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from spanframe import fixtures as fx
from spanframe.catalog.cte import sql
from spanframe.catalog.intervals import islands_sql
from spanframe.catalog.registry import query
from spanframe.catalog.text import WORDS, words
from spanframe.catalog.timeline import NOMINAL, hu
from spanframe.operators import intervals as iv
from spanframe.operators import timeline as tl
from spanframe.plans import findings as fd
from spanframe.plans.rounds import shared_folder
from spanframe.sources import readers as rd
from spanframe.sources import sinks as sk
from spanframe.sources.sinks import write_findings
from spanframe.sql import register


def works_cues(spark, d):
    """Cues as captions of one work per conversation, on odd microseconds."""
    c = fx.cues(spark, d)
    return c.select(F.col("source_id").alias("work_id"), "cue_id", (F.col("start_us") + 777).alias("start_us"), F.when(F.col("ord") == 4, F.col("start_us") + 900).otherwise(F.col("end_us") + 1499).alias("end_us"), F.regexp_replace("text", r"\s+", " ").alias("text"))


WC = r"""wc AS (SELECT source_id AS work_id, cue_id, ord, start_us + 777 AS a, CASE WHEN ord = 4 THEN start_us + 900 ELSE end_us + 1499 END AS b, regexp_replace(text, '\s+', ' ', 'g') AS text FROM cues),
 ms AS (SELECT *, """ + hu("a", "1000") + " AS m0, " + hu("b", "1000") + " AS m1 FROM wc)"
OK = WC + r""", okc AS (SELECT *, row_number() OVER (PARTITION BY work_id ORDER BY a, b, cue_id) AS pos FROM ms WHERE m1 > m0 AND NOT contains(text, '-->'))"""


@query("srt_rows", sql(OK + " SELECT work_id, pos, cue_id, m0 AS start_ms, m1 AS end_ms FROM okc", "cues"))
def srt_rows(spark, d):
    return sk.srt_rows(works_cues(spark, d))[0].drop("block")


@query("srt_findings", sql(WC + " SELECT cue_id AS entity_id, 'CUE_TOO_SHORT_FOR_SRT' AS rule_id FROM ms WHERE m1 <= m0", "cues"))
def srt_findings(spark, d):
    return sk.srt_rows(works_cues(spark, d))[1].select("entity_id", "rule_id")


def _srt(spark, d):
    return sk.srt_text(works_cues(spark, d)).select(F.col("work_id").alias("path"), "value")


@query("srt_round_trip", sql(OK + " SELECT work_id AS path, m0*1000 AS start_us, m1*1000 AS end_us FROM okc WHERE trim(text) <> ''", "cues"))
def srt_round_trip(spark, d):
    return rd.parse_srt(_srt(spark, d)).select("path", "start_us", "end_us")


@query("srt_strict_round_trip", sql(OK + " SELECT work_id AS path, pos, m0*1000 AS start_us, m1*1000 AS end_us, sha256(trim(text)) AS text_sha FROM okc WHERE trim(text) <> ''", "cues"))
def srt_strict_round_trip(spark, d):
    return rd.parse_srt_strict(_srt(spark, d))[0].withColumn("text_sha", F.sha2("text", 256)).drop("text")


@query("ass_round_trip", sql(r"SELECT source_id AS path, start_us // 10000 * 10000 AS start_us, (end_us + 10000) // 10000 * 10000 AS end_us, speaker || ', ' || ord AS text FROM cues", "cues"))
def ass_round_trip(spark, d):
    c = fx.cues(spark, d)
    def clock(us):
        cs = F.call_function("div", us, F.lit(10_000))
        div = lambda a, b: F.call_function("div", a, F.lit(b))
        return F.format_string("%d:%02d:%02d.%02d", div(cs, 360_000), F.pmod(div(cs, 6000), F.lit(60)), F.pmod(div(cs, 100), F.lit(60)), F.pmod(cs, F.lit(100)))
    line = F.concat(F.lit("Dialogue: 0,"), clock(F.col("start_us")), F.lit(","), clock(F.col("end_us") + 10_000), F.lit(",Default,{\\b1}"), F.col("speaker"), F.lit(", "), F.col("ord"))
    head = F.lit("[Events]\nFormat: Layer, Start, End, Style, Text\n")
    t = c.select(F.col("source_id").alias("path"), F.concat(head, line).alias("value"))
    # one text per cue keeps every parsed file small; the path carries the cue
    t = t.withColumn("path", F.concat_ws("|", "path", F.substring_index("value", ",", -1)))
    return rd.parse_ass(t).select(F.substring_index("path", "|", 1).alias("path"), "start_us", "end_us", "text")


LOGS = """lg AS (SELECT CAST(user_id AS VARCHAR) AS path, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS row, CASE WHEN event_id % 17 <> 0 THEN epoch_us(ts) END AS t_us, value AS rms, CASE WHEN event_type <> 'error' THEN value / 2 END AS peak FROM events)"""


KEYS = ["lavfi.astats.Overall.rms", "lavfi.astats.Overall.peak"]


def _log_lines(spark, d):
    """The log lines of each event, by source."""
    e = fx.table(spark, d, "events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")))
    sec = F.format_string("%d.%06d", F.call_function("div", F.col("t"), F.lit(1_000_000)), F.pmod("t", F.lit(1_000_000)))
    stamp = F.when(F.col("event_id") % 17 == 0, F.lit("frame:0 pts:1\n")).otherwise(F.concat(F.lit("frame:0 pts:1 pts_time:"), sec, F.lit("\n")))
    txt = F.concat(stamp, F.lit("lavfi.astats.Overall.rms="), F.col("value"), F.lit("\nlavfi.astats.Overall.peak="), F.when(F.col("event_type") == "error", "-inf").otherwise((F.col("value") / 2).cast("string")), F.lit("\nother=x"))
    return e.select(F.col("user_id").cast("string").alias("path"), "event_id", txt.alias("x"))


def logs(spark, d):
    """One measurement log per source, with all its frames."""
    by = _log_lines(spark, d).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("event_id", "x"))).alias("all"))
    t = by.select("path", F.concat(F.lit("ignored=1\n"), F.array_join(F.transform("all", lambda v: v["x"]), "\n")).alias("value"))
    return rd.parse_signal_log(t, KEYS)


@query("signal_log", f"WITH {LOGS} SELECT * FROM lg")
def signal_log(spark, d):
    return logs(spark, d)


@query("signal_log_files", f"WITH {LOGS} SELECT * FROM lg")
def signal_log_files(spark, d):
    """The same logs from one file a path, read by lines."""
    folder = f"{shared_folder(spark).rstrip('/')}/logs-{uuid.uuid4().hex}"
    lines = _log_lines(spark, d).repartition("path").sortWithinPartitions("path", "event_id")
    lines.select("path", F.col("x").alias("value")).write.partitionBy("path").text(folder)
    r = rd.read_signal_log(spark, f"{folder}/path=*/*.txt", KEYS)
    return r.withColumn("path", F.regexp_extract("path", "path=([^/]+)/", 1))


@query(
    "signal_log_findings",
    f"""WITH {LOGS}, p AS (SELECT *, lag(t_us) OVER (PARTITION BY path ORDER BY row) AS p FROM lg)
     SELECT path, CAST(row AS VARCHAR) AS entity_id, 'MEASUREMENT_TIMESTAMP_MISSING' AS rule_id FROM p WHERE t_us IS NULL UNION ALL SELECT path, CAST(row AS VARCHAR), 'MEASUREMENT_TIME_NOT_INCREASING' FROM p WHERE t_us <= p""",
)
def signal_log_findings(spark, d):
    return rd.check_signal_log(logs(spark, d)).select(F.col("work_id").alias("path"), "entity_id", "rule_id")


@query(
    "findings_written",
    "SELECT CASE WHEN c_nationkey % 2 = 0 THEN 'EVEN' ELSE 'ODD' END AS rule_id, CAST(c_custkey AS VARCHAR) AS entity_id FROM customer UNION ALL SELECT 'TWICE', CAST(c_custkey AS VARCHAR) FROM customer WHERE c_custkey % 3 = 0",
)
def findings_written(spark, d):
    """Findings appended to a folder per rule and read back."""
    c = fx.table(spark, d, "customer").withColumn("work_id", F.lit("w"))
    one = fd.finding(c, "EVEN", F.col("c_nationkey") % 2 == 0, F.col("c_custkey").cast("string")).unionByName(fd.finding(c, "ODD", F.col("c_nationkey") % 2 == 1, F.col("c_custkey").cast("string")))
    path = f"{shared_folder(spark).rstrip('/')}/findings-{uuid.uuid4().hex}"
    write_findings(one, path)
    write_findings(fd.finding(c, "TWICE", F.col("c_custkey") % 3 == 0, F.col("c_custkey").cast("string")), path)
    return spark.read.parquet(path).select("rule_id", "entity_id")


def tracks(spark, d):
    """Interchange tracks: the video cut list of each work, shifted now and then."""
    e = tl.build_edl(fx.segments(spark, d), fx.visuals(spark, d))
    return e.select("work_id", F.lit("video").alias("track_id"), F.lit("Video").alias("kind"), F.concat_ws("-", "segment_id", "ord").alias("instance_id"), F.col("source_id").alias("resource_id"), "start_us", (F.col("end_us") - F.col("start_us")).alias("duration_us"),
                    (F.col("out_start_us") + F.col("seg_ord") * 1000).alias("target_start_us"))


TRK = NOMINAL + """, cv AS (SELECT v.*, s.mode, s.ord AS so, coalesce(CASE WHEN s.voice_us > 0 THEN s.voice_us END, s.planned_us) AS budget, CAST(sum(v.end_us - v.start_us) OVER (PARTITION BY v.work_id, v.segment_id ORDER BY v.ord) AS BIGINT) - (v.end_us - v.start_us) AS local_us FROM visuals v JOIN segments s ON s.work_id = v.work_id AND s.segment_id = v.segment_id),
 us AS (SELECT * FROM (SELECT *, CASE WHEN mode = 'original' THEN end_us - start_us ELSE least(end_us - start_us, budget - local_us) END AS used_us FROM cv) WHERE used_us > 0),
 trk AS (SELECT u.work_id, u.segment_id || '-' || u.ord AS instance_id, u.source_id AS resource_id, u.start_us, used_us AS duration_us, n.out_end_us - n.dur_us + local_us + so*1000 AS target_start_us FROM us u JOIN nominal n ON n.segment_id = u.segment_id),
 tp AS (SELECT *, coalesce(lag(target_start_us + duration_us) OVER (PARTITION BY work_id ORDER BY target_start_us, instance_id), 0) AS p FROM trk)"""


@query("interchange_items", sql(TRK + " SELECT work_id, 'Clip.2' AS schema, instance_id, target_start_us, duration_us FROM tp UNION ALL SELECT work_id, 'Gap.1', NULL, p, target_start_us - p FROM tp WHERE target_start_us > p", "segments", "visuals"))
def interchange_items(spark, d):
    every = fx.visuals(spark, d).select("work_id", F.lit("video").alias("track_id"))  # the cut list plays each visual once at most
    return sk.interchange_items(tracks(spark, d), every)[0].select("work_id", "schema", "instance_id", "target_start_us", "duration_us")


@query("interchange_readback", sql(TRK + " SELECT instance_id, resource_id, start_us, duration_us, target_start_us FROM tp WHERE NOT EXISTS (SELECT 1 FROM tp x WHERE x.work_id = tp.work_id AND x.target_start_us < x.p)", "segments", "visuals"))
def interchange_readback(spark, d):
    t = tracks(spark, d)
    bad = sk.interchange_items(t)[1].select("work_id").distinct()
    t = t.join(bad, "work_id", "left_anti")
    docs = sk.interchange_json(t).select(F.col("work_id").alias("path"), "value")
    items, _, _ = rd.parse_interchange(docs, t.select("instance_id", "track_id"))
    return items.select("instance_id", "resource_id", "start_us", "duration_us", "target_start_us")


@query("interchange_findings", "SELECT CAST(o_orderkey AS VARCHAR) AS path, 'video/1' AS entity_id, CASE o_orderkey % 4 WHEN 1 THEN 'HOST_ITEM_SCHEMA_UNSUPPORTED' WHEN 2 THEN 'INSTANCE_ID_MISSING_UNKNOWN_OR_DUPLICATE' ELSE 'HOST_SOURCE_RANGE_INVALID' END AS rule_id FROM orders WHERE o_orderkey % 4 > 0 UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'video', 'HOST_TRAILING_GAP_REQUIRES_EXPLICIT_MAPPING' FROM orders")
def interchange_findings(spark, d):
    o, k = fx.table(spark, d, "orders"), F.col("o_orderkey")
    clip = lambda i, st, sc: F.struct(sc.alias("schema"), i.alias("instance_id"), F.lit("r").alias("resource_id"), st.alias("start_us"), F.lit(5).cast("bigint").alias("duration_us"), F.lit(True).alias("enabled"))
    two = clip(F.when(k % 4 == 2, "zz").otherwise(F.concat(F.lit("b"), k)), F.when(k % 4 == 3, -1).otherwise(0).cast("bigint"), F.when(k % 4 == 1, "Stack.1").otherwise("Clip.2"))
    kids = F.array(clip(F.concat(F.lit("a"), k), F.lit(0).cast("bigint"), F.lit("Clip.1")), two, clip(F.lit(None).cast("string"), F.lit(0).cast("bigint"), F.lit("Gap.1")))
    t = o.select(k.cast("string").alias("path"), F.to_json(F.struct(F.array(F.struct(F.lit("video").alias("track_id"), F.lit("Video").alias("kind"), kids.alias("children"))).alias("tracks"))).alias("value"))
    base = o.select(F.explode(F.array(F.concat(F.lit("a"), k), F.concat(F.lit("b"), k))).alias("instance_id"), F.lit("video").alias("track_id"))
    return rd.parse_interchange(t, base)[2].select(F.col("work_id").alias("path"), "entity_id", "rule_id")


@query("work_documents", sql("SELECT clip_id, 1 AS ord, source_id, start_us, end_us, mute FROM clips", "clips"))
def work_documents(spark, d):
    c = fx.clips(spark, d)
    clip = F.struct(F.col("clip_id").alias("id"), "source_id", "start_us", "end_us", F.col("gain_db").cast("double").alias("gain_db"), "mute", "speed_num", "speed_den")
    doc = F.to_json(F.struct(F.col("clip_id").alias("work_id"), F.struct("fps_num", "fps_den", F.array(clip).alias("clips")).alias("plan"), F.create_map("clip_id", F.lit("note")).alias("notes")))
    return rd.parse_works(c.select(doc.alias("value")))["clips"].select("clip_id", "ord", "source_id", "start_us", "end_us", "mute")


@query(
    "word_checks",
    sql(
        """w AS (SELECT CAST(l_partkey % 50 AS VARCHAR) AS s, l_orderkey || ':' || ord AS id, l_orderkey*100 + ord AS o, l_suppkey*250000 AS a, l_suppkey*250000 + CASE WHEN l_linenumber = 7 THEN 0 ELSE 400000 END AS b, CASE WHEN l_tax = 0 THEN '' ELSE 'w' END AS tx, l_discount*12 AS cf FROM lines), d AS (SELECT source_id AS s, duration_us AS du FROM sources),
     l AS (SELECT w.*, du, lag(a) OVER (PARTITION BY w.s ORDER BY o) AS p FROM w LEFT JOIN d ON d.s = w.s)
     SELECT id AS entity_id, 'WORD_TEXT_REQUIRED' AS rule_id FROM l WHERE tx = '' UNION ALL SELECT id, 'SOURCE_RANGE_INVALID' FROM l WHERE du IS NULL OR b <= a OR b > du + 1 UNION ALL SELECT id, 'WORDS_NOT_CHRONOLOGICAL' FROM l WHERE a < p UNION ALL SELECT id, 'CONFIDENCE_OUT_OF_RANGE' FROM l WHERE cf > 1""",
        "lines", "sources",
    ),
)
def word_checks(spark, d):
    a = F.col("l_suppkey") * 250_000
    w = fx.lines(spark, d).select((F.col("l_partkey") % 50).cast("string").alias("source_id"), F.concat_ws(":", "l_orderkey", "ord").alias("word_id"), (F.col("l_orderkey") * 100 + F.col("ord")).alias("ord"), a.alias("start_us"), (a + F.when(F.col("l_linenumber") == 7, 0).otherwise(400_000)).alias("end_us"),
        F.when(F.col("l_tax") == 0, "").otherwise("w").alias("text"), F.lit("s").alias("speaker"), (F.col("l_discount") * 12).alias("confidence"))
    return rd.validate_words(w, fx.sources(spark, d)).select("entity_id", "rule_id")


@query(
    "asr_issues",
    sql(
        """w AS (SELECT work_id AS s, ord AS seg, 0 AS pos, 'a b' AS tx, start_us AS a, CASE WHEN gain_db = -10 THEN start_us ELSE end_us END AS b FROM clips WHERE ord % 5 <> 4), sg AS (SELECT work_id AS s, ord AS seg, CASE WHEN gain_db = -9 THEN 'zz' ELSE 'ab' END AS tx FROM clips),
     p AS (SELECT *, max(CASE WHEN b > a THEN a END) OVER (PARTITION BY s ORDER BY seg ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pa FROM w)
     SELECT s AS source_id, seg, 'INVALID_OR_ZERO_WORD_SPAN_PROBABILITY_OR_TEXT' AS reason FROM p WHERE b <= a OR a < pa UNION ALL SELECT sg.s, sg.seg, 'TEXT_WITHOUT_WORD_TIMES' FROM sg LEFT JOIN w ON w.s = sg.s AND w.seg = sg.seg WHERE w.s IS NULL
     UNION ALL SELECT sg.s, sg.seg, 'SEGMENT_WORD_TEXT_MISMATCH' FROM sg LEFT JOIN w ON w.s = sg.s AND w.seg = sg.seg WHERE w.s IS NULL OR sg.tx = 'zz'""",
        "clips",
    ),
)
def asr_issues(spark, d):
    c = fx.clips(spark, d)
    w = c.where("ord % 5 <> 4").select(F.col("work_id").alias("source_id"), F.col("ord").alias("seg"), F.lit(0).cast("bigint").alias("pos"), F.lit("a b").alias("text"), "start_us", F.when(F.col("gain_db") == -10, F.col("start_us")).otherwise(F.col("end_us")).alias("end_us"), F.lit(0.5).alias("confidence"))
    s = c.select(F.col("work_id").alias("source_id"), F.col("ord").alias("seg"), F.when(F.col("gain_db") == -9, "zz").otherwise("ab").alias("text"))
    return rd.normalize_asr(w, s)[1]


@query(
    "alignment_states",
    sql(
        """c AS (SELECT source_id, cue_id, ord, start_us, end_us + CASE WHEN ord = 2 THEN 1000000 ELSE 0 END AS end_us FROM cues), l AS (SELECT DISTINCT a.cue_id FROM c a JOIN c b ON a.source_id = b.source_id AND a.cue_id <> b.cue_id AND a.start_us < b.end_us AND b.start_us < a.end_us)
     SELECT cue_id, CASE WHEN cue_id IN (SELECT cue_id FROM l) THEN 'overlapping_subtitle_cues' WHEN ord % 3 = 1 THEN 'incomplete_or_inferred_tokens' ELSE '' END AS reason FROM c JOIN cues USING (cue_id, ord) WHERE text <> ''""",
        "cues",
    ).replace("JOIN cues USING (cue_id, ord)", "JOIN (SELECT cue_id, text FROM cues) USING (cue_id)"),
)
def alignment_states(spark, d):
    c = fx.cues(spark, d).withColumn("end_us", F.col("end_us") + F.when(F.col("ord") == 2, 1_000_000).otherwise(0))
    w = words(spark, d)
    n = F.substring_index("cue_id", ":", -1).cast("int")
    t = w.select("source_id", "cue_id", "ord", "text", F.when((n % 3 == 1) & (F.col("ord") == 0), "interpolated").otherwise("observed").alias("status"), "start_us", "end_us", F.lit(0.9).alias("score"))
    return rd.apply_alignment(c, w, t)[1].select("cue_id", F.coalesce("reason", F.lit("")).alias("reason"))


@query("char_tokens", sql(WORDS + " SELECT cue_id, ord, CASE WHEN length(text) > 8 THEN 'missing' ELSE 'observed' END AS status, CASE WHEN length(text) <= 8 THEN ord*1000000 END AS start_us, CASE WHEN length(text) <= 8 THEN ord*1000000 + length(text)*10 END AS end_us FROM words", "cues"))
def char_tokens(spark, d):
    w = words(spark, d).select("source_id", "cue_id", "ord", "text", (F.col("ord") * 1000).cast("int").alias("c0"), (F.col("ord") * 1000 + F.length("text")).cast("int").alias("c1"))
    ch = w.withColumn("pos", F.explode(F.sequence("c0", F.col("c1") - 1)))
    k = F.col("pos") - F.col("c0")
    ch = ch.where(k < 8).select("source_id", "cue_id", "pos", (F.col("ord") * 1_000_000 + k * 10).alias("start_us"), (F.col("ord") * 1_000_000 + (k + 1) * 10).alias("end_us"), F.lit(0.5).alias("score"))
    return rd.chars_to_tokens(ch, w).select("cue_id", "ord", "status", "start_us", "end_us")


@query(
    "sidecar_pairs",
    """SELECT CAST(c_nationkey AS VARCHAR) AS folder, 'Film ' || c_custkey || '.mp4' AS name, CASE c_custkey % 5 WHEN 0 THEN 'paired' WHEN 1 THEN 'paired' WHEN 2 THEN 'ambiguous' ELSE 'none' END AS state, CASE c_custkey % 5 WHEN 0 THEN 'film ' || c_custkey || '.SRT' WHEN 1 THEN 'Film ' || c_custkey || '.zh-CN.forced.ass' END AS sidecar FROM customer""",
)
def sidecar_pairs(spark, d):
    c = fx.table(spark, d, "customer")
    fo, k = F.col("c_nationkey").cast("string").alias("folder"), F.col("c_custkey")
    stem = F.concat(F.lit("Film "), k)
    v = c.select(fo, F.concat(stem, F.lit(".mp4")).alias("name"))
    names = (
        F.when(k % 5 == 0, F.array(F.concat(F.lit("film "), k, F.lit(".SRT")), F.concat(stem, F.lit(".ass")), F.concat(stem, F.lit(".en.srt"))))
        .when(k % 5 == 1, F.array(F.concat(stem, F.lit(".zh-CN.forced.ass")), F.concat(stem, F.lit("x.srt")), F.concat(stem, F.lit(".txt"))))
        .when(k % 5 == 2, F.array(F.concat(stem, F.lit(".en.srt")), F.concat(stem, F.lit("_de.srt"))))
        .otherwise(F.array(F.concat(stem, F.lit(".commentary.srt"))))
    )
    return rd.pair_sidecars(v, c.select(fo, F.explode(names).alias("name")))


@query("script_lines", sql("SELECT work_id, ord AS pos, segment_id, mode FROM segments", "segments"))
def script_lines(spark, d):
    r = sk.script_rows(fx.segments(spark, d), fx.visuals(spark, d))
    return r.select("work_id", "pos", F.regexp_extract("line", r"\] (\d+)", 1).alias("segment_id"), F.when(F.contains("line", F.lit("解说")), "voiceover").otherwise("original").alias("mode"))


@query("edl_lines", sql(NOMINAL + ", u AS (SELECT segment_id, count(*) AS n FROM (SELECT v.segment_id, s.mode, coalesce(CASE WHEN s.voice_us > 0 THEN s.voice_us END, s.planned_us) AS bg, sum(v.end_us - v.start_us) OVER (PARTITION BY v.segment_id ORDER BY v.ord) - (v.end_us - v.start_us) AS l FROM visuals v JOIN segments s ON s.segment_id = v.segment_id) WHERE mode = 'original' OR l < bg GROUP BY 1) SELECT s.work_id, s.ord AS seg_ord, s.segment_id, coalesce(n, 0) AS n_spans FROM segments s LEFT JOIN u USING (segment_id)", "segments", "visuals"))
def edl_lines(spark, d):
    s, v = fx.segments(spark, d), fx.visuals(spark, d)
    r = sk.edl_rows(tl.build_edl(s, v), s)
    return r.select("work_id", "seg_ord", F.get_json_object("line", "$.segment_id").alias("segment_id"), F.coalesce(F.json_array_length(F.get_json_object("line", "$.source_spans")), F.lit(0)).cast("bigint").alias("n_spans"))


@query(
    "source_files",
    "SELECT CAST(c_nationkey AS VARCHAR) AS source_id, CAST(sum(octet_length(encode(c_name)) + 1) AS BIGINT) AS bytes, sha256(string_agg(c_name, chr(10) ORDER BY c_custkey) || chr(10)) AS sha256 FROM customer GROUP BY c_nationkey",
)
def source_files(spark, d):
    """A registry of files, which hold the customer names of a nation each."""
    c = fx.table(spark, d, "customer").select("c_nationkey", "c_custkey", "c_name")
    path = f"{shared_folder(spark).rstrip('/')}/sources-{uuid.uuid4().hex}"
    c.repartition("c_nationkey").sortWithinPartitions("c_nationkey", "c_custkey").select("c_nationkey", "c_name").write.partitionBy("c_nationkey").text(path)
    r = rd.register_sources(spark, f"{path}/c_nationkey=*/*.txt")
    return r.select(F.regexp_extract("path", "c_nationkey=(\\d+)", 1).alias("source_id"), "bytes", "sha256")


@query("source_registry", "SELECT CAST(c_custkey AS VARCHAR) AS entity_id, CASE WHEN c_nationkey % 5 = 0 THEN 'SOURCE_NOT_FOUND' WHEN c_nationkey % 5 = 1 THEN 'SOURCE_HASH_MISMATCH' ELSE 'SOURCE_SIZE_MISMATCH' END AS rule_id FROM customer WHERE c_nationkey % 5 < 3")
def source_registry(spark, d):
    """Declared references against a registry built from the customer rows."""
    c, m = fx.table(spark, d, "customer"), F.col("c_nationkey") % 5
    p = F.col("c_custkey").cast("string").alias("path")
    reg = c.where(m != 0).select(p, F.sha2("c_name", 256).alias("sha256"), F.length("c_name").alias("bytes"))
    dec = c.select(p, F.when(m == 1, "x").otherwise(F.sha2("c_name", 256)).alias("sha256"), F.when(m == 2, 0).otherwise(F.length("c_name")).alias("bytes"))
    return rd.verify_sources(reg, dec).select("entity_id", "rule_id")


@query("sql_surface", islands_sql("SELECT source_id, count(*) AS n, CAST(sum(end_us - start_us) AS BIGINT) AS us FROM islands GROUP BY 1"))
def sql_surface(spark, d):
    """An operator used from SQL through a registered view."""
    register(spark, "spanframe_islands", iv.merge_spans, fx.spans(spark, d), keys=["source_id"])
    return spark.sql("SELECT source_id, count(*) AS n, sum(end_us - start_us) AS us FROM spanframe_islands GROUP BY source_id")
