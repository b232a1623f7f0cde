"""Queries of the text operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanframe import fixtures as fx
from spanframe.catalog.cte import sql
from spanframe.catalog.registry import query
from spanframe.catalog.timeline import NOMINAL, USED, he
from spanframe.functions import fixed
from spanframe.functions import text as tf
from spanframe.operators import rules as qc
from spanframe.operators import text as tx

TOKEN_RE = r"[\x{3400}-\x{9fff}]|[A-Za-z0-9]+(?:[-_.''’][A-Za-z0-9]+)*|[^\s]"
SPACE_RE = r"[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x1c-\x1f]+"
TOKENS = f"""tk AS (SELECT source_id, cue_id, start_us, end_us, unnest(regexp_extract_all(text, '{TOKEN_RE}')) AS token,
  generate_subscripts(regexp_extract_all(text, '{TOKEN_RE}'), 1) - 1 AS pos FROM cues)"""
WORDS = (
    TOKENS
    + f""", tw AS (SELECT *, CASE WHEN regexp_matches(token, '^[，。！？；：、,.!?;:]$') THEN 1 ELSE 4 END AS w FROM tk),
  tp AS (SELECT *, sum(w) OVER (PARTITION BY cue_id ORDER BY pos) AS upto, sum(w) OVER (PARTITION BY cue_id) AS total FROM tw),
  words AS (SELECT source_id, cue_id, CAST(pos AS BIGINT) AS ord, start_us + {he('(end_us - start_us)*(upto - w)', 'total')} AS start_us,
   start_us + {he('(end_us - start_us)*upto', 'total')} AS end_us, token AS text FROM tp)"""
)


query("tokenize", sql(TOKENS + " SELECT cue_id, CAST(pos AS BIGINT) AS pos, token FROM tk", "cues"))(
    lambda s, d: tx.tokenize(fx.cues(s, d)).select("cue_id", F.col("pos").cast("bigint").alias("pos"), "token")
)
query("spread_words", sql(WORDS + " SELECT cue_id, ord, start_us, end_us, text, end_us - start_us < 1000 AS below_floor FROM words", "cues"))(
    lambda s, d: tx.spread_words(fx.cues(s, d)).select("cue_id", "ord", "start_us", "end_us", "text", "below_floor")
)


def _short(spark, d):
    """Cues too short for their words: a fifth of a millisecond to 1.3 ms a character."""
    c = fx.cues(spark, d)
    return c.withColumn("end_us", F.col("start_us") + F.length("text") * (200 + F.pmod(F.length("text"), F.lit(7)) * 150) + 1)


@query(
    "spread_words_floor",
    sql(
        TOKENS.replace("FROM cues", "FROM (SELECT * REPLACE (start_us + length(text) * (200 + length(text) % 7 * 150) + 1 AS end_us) FROM cues)")
        + """, l AS (SELECT cue_id, start_us, end_us, list(token ORDER BY pos) AS ts, list(CASE WHEN regexp_matches(token, '^[，。！？；：、,.!?;:]$') THEN 1 ELSE 4 END ORDER BY pos) AS ws FROM tk GROUP BY ALL),
      w(cue_id, k, s, e, base, rest, upto, f) AS (
        SELECT cue_id, CAST(0 AS BIGINT), start_us, start_us, start_us, CAST(list_sum(ws) AS BIGINT), CAST(0 AS BIGINT), false FROM l
        UNION ALL SELECT cue_id, k + 1, e, CASE WHEN m - e < 1000 THEN e + 1000 ELSE m END, CASE WHEN m - e < 1000 THEN e + 1000 ELSE base END,
          CASE WHEN m - e < 1000 THEN rest - upto - x ELSE rest END, CASE WHEN m - e < 1000 THEN 0 ELSE upto + x END, m - e < 1000
        FROM (SELECT w.*, ws[k + 1] AS x, base + CAST(round_even(CAST((end_us - base) * (upto + ws[k + 1]) AS DOUBLE) / rest, 0) AS BIGINT) AS m FROM w JOIN l USING (cue_id) WHERE k < len(ws)))
      SELECT cue_id, k - 1 AS ord, s AS start_us, e AS end_us, ts[k] AS text, f AS below_floor FROM w JOIN l USING (cue_id) WHERE k > 0""",
        "cues",
    ).replace("WITH ", "WITH RECURSIVE ", 1),
)
def spread_words_floor(spark, d):
    """Word times where the floor moves most words."""
    return tx.spread_words(_short(spark, d)).select("cue_id", "ord", "start_us", "end_us", "text", "below_floor")


def words(spark, d):
    """Word rows; every other cue counts as reliably aligned."""
    w = tx.spread_words(fx.cues(spark, d))
    even = F.substring_index("cue_id", ":", -1).cast("int") % 2 == 0
    return w.withColumn("timing", F.when(even, "aligned").otherwise("estimated"))


def _quoted(texts) -> str:
    return "[" + ", ".join("'" + t.replace("'", "''") + "'" for t in texts) + "]"


# One pass over the references, as in the operator; the names come from Python's table there too.
UNESCAPED = rf"""nm AS (SELECT MAP({_quoted(tf.NAMED)}, {_quoted(tf.NAMED.values())}) AS names, MAP({list(tf.WINDOWS)}, {_quoted(tf.WINDOWS.values())}) AS windows),
 cut AS (SELECT page_id, regexp_split_to_array(bare, '{tf.REFERENCE}') AS parts, regexp_extract_all(bare, '{tf.REFERENCE}') AS refs FROM (SELECT page_id, regexp_replace(html, '<[^>]+>|\{{\\[^}}]+\}}', '', 'g') AS bare FROM raw)),
 num AS (SELECT page_id, parts, list_transform(refs, lambda r: {{'b': substr(r, 2), 'u': regexp_extract(substr(r, 2), '{tf.UNCLOSED}'),
   'c': CASE WHEN r[2] <> '#' THEN NULL WHEN lower(r[3]) = 'x' THEN try_cast('0x' || regexp_extract(r, '[xX]([0-9a-fA-F]+)', 1) AS BIGINT) ELSE try_cast(regexp_extract(r, '[0-9]+') AS BIGINT) END}}) AS refs FROM cut),
 clean AS (SELECT page_id, array_to_string(list_transform(range(1, len(parts) + 1), lambda i: parts[i] || CASE WHEN i > len(refs) THEN '' WHEN refs[i].b[1] = '#' THEN
   coalesce(windows[CAST(refs[i].c AS INT)], CASE WHEN refs[i].c > 1114111 OR refs[i].c BETWEEN 55296 AND 57343 THEN chr(65533)
     WHEN refs[i].c BETWEEN 1 AND 8 OR refs[i].c = 11 OR refs[i].c BETWEEN 14 AND 31 OR refs[i].c = 127 OR refs[i].c BETWEEN 64976 AND 65007 OR refs[i].c % 65536 >= 65534 THEN '' ELSE chr(CAST(refs[i].c AS INT)) END)
   ELSE coalesce(names[refs[i].b], names[refs[i].u] || substr(refs[i].b, length(refs[i].u) + 1), '&' || refs[i].b) END), '') AS t FROM num, nm)
 SELECT page_id, sha256(trim(regexp_replace(replace(replace(t, '\N', ' '), '\n', ' '), '{SPACE_RE}', ' ', 'g'))) AS clean_sha FROM clean"""


@query("clean_text", "WITH raw AS (SELECT page_id, html FROM pages), " + UNESCAPED)
def clean_text(spark, d):
    return fx.table(spark, d, "pages").select("page_id", F.sha2(tf.clean_text("html"), 256).alias("clean_sha"))


@query(
    "clean_references",
    "WITH raw AS (SELECT page_id, html || ' caf&eacute; &mdash; &#' || (128 + page_id % 40) || '; &#x' || page_id % 10 || '; &#38;lt; &amp;lt; &notit; &copy' || page_id || ' &x;' AS html FROM pages), " + UNESCAPED,
)
def clean_references(spark, d):
    """Pages with references of all kinds behind them."""
    more = [" caf&eacute; &mdash; &#", 128 + F.col("page_id") % 40, "; &#x", F.col("page_id") % 10, "; &#38;lt; &amp;lt; &notit; &copy", F.col("page_id"), " &x;"]
    html = F.concat("html", *[F.lit(x) if isinstance(x, str) else x.cast("string") for x in more])
    return fx.table(spark, d, "pages").select("page_id", F.sha2(tf.clean_text(html), 256).alias("clean_sha"))


MEASURES = rf"""len(regexp_extract_all(text, '[\x{{3400}}-\x{{9fff}}]')) + len(regexp_extract_all(text, '[A-Za-z0-9]+')) + len(regexp_extract_all(text, '[，。！？；：,.!?;:]')) // 3 AS text_units,
 length(regexp_replace(text, '{SPACE_RE}', '', 'g')) AS visible_units, length(text) AS code_points"""


@query("text_units", f"SELECT doc_id, {MEASURES} FROM documents")
def text_units(spark, d):
    return fx.table(spark, d, "documents").select("doc_id", tf.text_units("text").alias("text_units"), tf.visible_units("text").alias("visible_units"), F.length("text").cast("bigint").alias("code_points"))


MARKS = "。！？!?；;，,"


def split_sql(source: str, limit: int = 32, tag: str = "") -> str:
    """CTEs that end in {tag}chunks(k, ord, chunk) of ``source(k, text)``: sentences, their cut heads, and the packing as a recursion."""
    return rf"""{tag}sq AS (SELECT k, trim(regexp_replace(text, '{SPACE_RE}', ' ', 'g')) AS t FROM ({source})),
     {tag}pc AS (SELECT k, p, row_number() OVER (PARTITION BY k ORDER BY j) AS i, length(replace(p, ' ', '')) AS u FROM (SELECT k, trim(unnest(regexp_extract_all(t, '[^{MARKS}]*[{MARKS}]|[^{MARKS}]+'))) AS p, generate_subscripts(regexp_extract_all(t, '[^{MARKS}]*[{MARKS}]|[^{MARKS}]+'), 1) AS j FROM {tag}sq) WHERE p <> ''),
     {tag}ct AS (SELECT *, CASE WHEN u <= {limit} THEN 0 ELSE list_min(list_filter(range(1, length(p) // {limit} + 2), lambda n: length(replace(substr(p, n * {limit} + 1), ' ', '')) <= {limit})) END AS c FROM {tag}pc),
     {tag}pr AS (SELECT k, i, c, substr(p, c * {limit} + 1) AS r, length(replace(substr(p, c * {limit} + 1), ' ', '')) AS ru, list_transform(range(0, c), lambda n: trim(substr(p, n * {limit} + 1, {limit}))) AS heads FROM {tag}ct),
     {tag}pk(k, i, open, n, done, heads) AS (SELECT DISTINCT k, CAST(0 AS BIGINT), '', CAST(0 AS BIGINT), '', CAST([] AS VARCHAR[]) FROM {tag}pr
     UNION ALL SELECT pr.k, pr.i, CASE WHEN c = 0 AND n + ru <= {limit} THEN open || r ELSE r END, CASE WHEN c = 0 AND n + ru <= {limit} THEN n + ru ELSE ru END, CASE WHEN c = 0 AND n + ru <= {limit} THEN '' ELSE trim(open) END, pr.heads FROM {tag}pk pk JOIN {tag}pr pr ON pr.k = pk.k AND pr.i = pk.i + 1),
     {tag}al AS (SELECT k, i, 0 AS j, done AS chunk FROM {tag}pk UNION ALL SELECT k, i, generate_subscripts(heads, 1), unnest(heads) FROM {tag}pk UNION ALL SELECT k, max(i) + 1, 0, trim(arg_max(open, i)) FROM {tag}pk GROUP BY 1),
     {tag}chunks AS (SELECT k, row_number() OVER (PARTITION BY k ORDER BY i, j) - 1 AS ord, chunk FROM {tag}al WHERE chunk <> '')"""


@query("split_caption", "WITH RECURSIVE " + split_sql("SELECT doc_id AS k, text FROM documents") + " SELECT k AS doc_id, CAST(ord AS INT) AS ord, chunk FROM chunks")
def split_caption(spark, d):
    return fx.table(spark, d, "documents").select("doc_id", F.posexplode(tf.split_caption("text", 32)).alias("ord", "chunk"))


FOLD = "(f.n + x.u > 32 OR x.s + x.d - f.s0 > 3200000 OR regexp_matches(x.text, '[。！？!?；;]$') AND x.s + x.d - f.s0 >= 900000)"
# from x(k, text, s, d, audio, i, u) to grouped(k, g, a, b, text)
GROUPED = f"""f(k, i, text, s, d, audio, s0, n, g) AS (SELECT k, i, text, s, d, audio, s, u, 1 FROM x WHERE i = 1
     UNION ALL SELECT x.k, x.i, x.text, x.s, x.d, x.audio, CASE WHEN {FOLD} THEN x.s ELSE f.s0 END, CASE WHEN {FOLD} THEN x.u ELSE f.n + x.u END, f.g + CASE WHEN {FOLD} THEN 1 ELSE 0 END FROM f JOIN x ON x.k = f.k AND x.i = f.i + 1),
     y AS (SELECT k, g, audio, arg_min(s, i) AS a, arg_max(s + d, i) AS e, string_agg(text, '' ORDER BY i) AS text FROM f GROUP BY 1, 2, 3),
     z AS (SELECT *, least(least(audio, greatest(e, a + 500000)), lead(a) OVER (PARTITION BY k ORDER BY g)) AS b FROM y),
     grouped AS (SELECT k, g, a, b, text FROM z WHERE b > a AND text <> '')"""


@query(
    "group_words",
    sql(
        WORDS
        + rf""", x AS (SELECT w.cue_id AS k, w.text, w.start_us - c.start_us AS s, greatest(w.end_us - w.start_us, 40000) AS d, c.end_us - c.start_us AS audio, row_number() OVER (PARTITION BY w.cue_id ORDER BY w.ord) AS i,
       length(regexp_replace(w.text, '{SPACE_RE}', '', 'g')) AS u FROM words w JOIN cues c ON c.cue_id = w.cue_id WHERE trim(w.text) <> ''), """
        + GROUPED
        + " SELECT k AS cue_id, CAST(g - 1 AS BIGINT) AS ord, a AS start_us, b AS end_us, text FROM grouped",
        "cues",
    ).replace("WITH ", "WITH RECURSIVE ", 1),
)
def group_words(spark, d):
    c = fx.cues(spark, d).select("cue_id", F.col("start_us").alias("c0"), (F.col("end_us") - F.col("start_us")).alias("audio_us"))
    w = words(spark, d).join(c, "cue_id").select("cue_id", "ord", "text", (F.col("start_us") - F.col("c0")).alias("start_us"), (F.col("end_us") - F.col("start_us")).alias("dur_us"), "audio_us")
    return tx.group_words(w, ["cue_id"], 32)


SHARE = rf"greatest(1, length(regexp_replace(chunk, '{SPACE_RE}', '', 'g')))"


@query(
    "spread_cues",
    sql(
        split_sql("SELECT cue_id AS k, text FROM cues WHERE end_us > start_us")
        + rf""", sz AS (SELECT k, ord, chunk, {SHARE} AS w, CAST(sum({SHARE}) OVER (PARTITION BY k ORDER BY ord) AS BIGINT) AS upto, CAST(sum({SHARE}) OVER (PARTITION BY k) AS BIGINT) AS whole FROM chunks),
     tm AS (SELECT k, sz.ord, chunk, {he('((end_us - start_us) * (upto - w))', 'whole')} AS a, {he('((end_us - start_us) * upto)', 'whole')} AS b FROM sz JOIN cues ON cue_id = k)
     SELECT k AS cue_id, CAST(ord AS BIGINT) AS ord, a AS start_us, b AS end_us, chunk AS text FROM tm WHERE b > a""",
        "cues",
    ).replace("WITH ", "WITH RECURSIVE ", 1),
)
def spread_cues(spark, d):
    c = fx.cues(spark, d).withColumn("dur_us", F.col("end_us") - F.col("start_us"))
    return tx.spread_cues(c, ["cue_id"], 32)


ORIG = (
    WORDS
    + ", "
    + USED.replace("used AS", "used0 AS")
    + """, u AS (SELECT *, start_us + used_us AS v1 FROM used0 WHERE mode = 'original'),
  p AS (SELECT u.work_id, u.segment_id, u.ord AS v_ord, u.start_us AS v0, v1, local_us, c.cue_id, c.text, c.start_us AS c0, c.end_us AS c1, c.ord AS c_ord,
    c.start_us >= u.start_us - 1000 AND c.end_us <= v1 + 1000 AS whole FROM u JOIN cues c ON c.source_id = u.source_id AND c.start_us < v1 AND u.start_us < c.end_us),
  pw AS (SELECT p.work_id, p.segment_id, v_ord, v0, v1, local_us, p.cue_id, string_agg(w.text, '' ORDER BY w.ord) AS text, arg_min(w.start_us, w.ord) AS c0, arg_max(w.end_us, w.ord) AS c1
    FROM p JOIN words w ON w.cue_id = p.cue_id AND c_ord % 2 = 0 AND w.start_us >= v0 - 1000 AND w.end_us <= v1 + 1000 WHERE NOT whole GROUP BY ALL),
  oc AS (SELECT work_id, segment_id, v_ord, v0, v1, local_us, cue_id, text, c0, c1, false AS partial FROM p WHERE whole UNION ALL SELECT *, true FROM pw)"""
).replace("local_us, p.cue_id, string_agg", "local_us, p.cue_id, string_agg")


@query(
    "original_cues",
    sql(
        ORIG
        + " SELECT work_id, segment_id, cue_id, v_ord, local_us + greatest(0, c0 - v0) AS start_us, local_us + least(v1, c1) - v0 AS end_us, sha256(text) AS text_sha, partial FROM oc WHERE trim(text) <> ''",
        "segments", "visuals", "cues",
    ),
)
def original_cues(spark, d):
    o = tx.original_cues(fx.segments(spark, d), fx.visuals(spark, d), fx.cues(spark, d), words(spark, d))
    return o.withColumn("text_sha", F.sha2("text", 256)).drop("text")


@query(
    "build_cues",
    sql(
        ORIG
        + ", "
        + NOMINAL
        + rf""", vo AS (SELECT *, coalesce(CASE WHEN voice_us > 0 THEN voice_us END, planned_us) AS audio FROM nominal WHERE mode = 'voiceover'),
     bw AS (SELECT segment_id AS k, audio, unnest(regexp_split_to_array(text, '[- ]')) AS text, generate_subscripts(regexp_split_to_array(text, '[- ]'), 1) - 1 AS o FROM vo WHERE ord % 2 = 0),
     x AS (SELECT k, text, o * 400000 AS s, 350000 AS d, audio, row_number() OVER (PARTITION BY k ORDER BY o) AS i, length(regexp_replace(text, '{SPACE_RE}', '', 'g')) AS u FROM bw WHERE trim(text) <> ''), """
        + GROUPED
        + ", "
        + split_sql("SELECT segment_id AS k, text FROM vo WHERE dur_us > 0 AND segment_id NOT IN (SELECT k FROM grouped)", 32, "s_")
        + rf""", sz AS (SELECT k, ord, chunk, {SHARE} AS w, CAST(sum({SHARE}) OVER (PARTITION BY k ORDER BY ord) AS BIGINT) AS upto, CAST(sum({SHARE}) OVER (PARTITION BY k) AS BIGINT) AS whole FROM s_chunks),
     tm AS (SELECT k, chunk, {he('(dur_us * (upto - w))', 'whole')} AS a, {he('(dur_us * upto)', 'whole')} AS b FROM sz JOIN vo ON vo.segment_id = sz.k),
     every AS (SELECT row_number() OVER () AS k, * FROM (SELECT k AS segment_id, a, b, text, 'word' AS kind FROM grouped UNION ALL SELECT k, a, b, chunk, 'spread' FROM tm WHERE b > a
       UNION ALL SELECT segment_id, local_us + greatest(0, c0 - v0), local_us + least(v1, c1) - v0, text, 'original' FROM oc WHERE trim(text) <> '')), """
        + split_sql("SELECT k, text FROM every", 16, "w_")
        + """, wr AS (SELECT k, string_agg(chunk, chr(10) ORDER BY ord) AS text FROM w_chunks GROUP BY 1)
     SELECT n.work_id, n.ord AS seg_ord, e.segment_id, e.a + n.out_end_us - n.dur_us AS start_us, e.b + n.out_end_us - n.dur_us AS end_us, coalesce(wr.text, '') AS text, kind FROM every e JOIN nominal n ON n.segment_id = e.segment_id LEFT JOIN wr ON wr.k = e.k""",
        "segments", "visuals", "cues",
    ).replace("WITH ", "WITH RECURSIVE ", 1),
)
def build_cues(spark, d):
    s = fx.segments(spark, d)
    b = s.where("mode = 'voiceover' and ord % 2 = 0").select("work_id", "segment_id", F.posexplode(F.split("text", "[- ]")).alias("ord", "text"))
    b = b.select("work_id", "segment_id", "ord", "text", (F.col("ord") * 400_000).cast("bigint").alias("start_us"), F.lit(350_000).cast("bigint").alias("dur_us"))
    return tx.build_cues(s, fx.visuals(spark, d), fx.cues(spark, d), words(spark, d), b)


@query(
    "reading_profile",
    sql(
        rf"""l AS (SELECT cue_id, end_us - start_us AS dur, list_transform(string_split(text, chr(10)), lambda s: length(regexp_replace(s, '{SPACE_RE}', '', 'g'))) AS sz FROM cues)
     SELECT cue_id, len(sz) AS n_lines, list_max(sz) AS longest_line, CAST(list_sum(sz) AS BIGINT) AS n_chars,
     concat_ws(',', CASE WHEN len(sz) > 2 THEN 'LINE_COUNT' END, CASE WHEN list_max(sz) > 160 THEN 'LINE_LENGTH' END, CASE WHEN list_sum(sz)*1000000 > 14*dur THEN 'READING_RATE' END) AS exceeded FROM l""",
        "cues",
    ),
)
def reading_profile(spark, d):
    return tx.reading_profile(fx.cues(spark, d), 2, 160, 14).select("cue_id", "n_lines", "longest_line", "n_chars", "exceeded")


@query(
    "literal_locks",
    sql(
        """k AS (SELECT cue_id AS lock_id, CASE WHEN ord = 6 THEN 'none' ELSE cue_id END AS cue_id, CASE WHEN length(text) % 2 = 0 THEN substr(text, 2, 12) ELSE 'zz' || substr(text, 1, 3) END AS t, ord % 4 = 3 AS ex FROM cues)
     SELECT lock_id, k.cue_id, CASE WHEN c.text IS NULL THEN 'LOCK_CUE_UNKNOWN' ELSE 'TARGET_LITERAL_MISMATCH' END AS rule_id FROM k LEFT JOIN cues c ON c.cue_id = k.cue_id
     WHERE c.text IS NULL OR NOT CASE WHEN ex THEN c.text = t ELSE contains(c.text, t) END""",
        "cues",
    ),
)
def literal_locks(spark, d):
    c = fx.cues(spark, d)
    t = F.when(F.length("text") % 2 == 0, F.substring("text", 2, 12)).otherwise(F.concat(F.lit("zz"), F.substring("text", 1, 3)))
    k = c.select(F.col("cue_id").alias("lock_id"), F.when(F.col("ord") == 6, "none").otherwise(F.col("cue_id")).alias("cue_id"), t.alias("text"), F.when(F.col("ord") % 4 == 3, "exact").otherwise("contains").alias("match"))
    return tx.literal_locks(k, c)


@query("literal_cover", "SELECT doc_id AS text_id, item_id AS needle_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def literal_cover(spark, d):
    n = fx.table(spark, d, "benchmark").select(F.col("item_id").alias("needle_id"), "text")
    return tx.literal_pairs(n, fx.table(spark, d, "documents").select(F.col("doc_id").alias("text_id"), "text"))


@query(
    "literal_short",
    """SELECT DISTINCT doc_id AS text_id, n.k AS needle_id FROM documents d JOIN (SELECT item_id * 3 + j AS k, array_to_string(string_split(text, ' ')[:j + 1], ' ') AS t FROM benchmark, range(3) r(j)) n ON contains(d.text, n.t)""",
)
def literal_short(spark, d):
    """Needles of one to three words, common ones among them."""
    j = F.explode(F.array(*[F.struct(F.lit(k).alias("j"), F.array_join(F.slice(F.split("text", " "), 1, k + 1), " ").alias("t")) for k in range(3)]))
    n = fx.table(spark, d, "benchmark").select("item_id", j.alias("x")).select((F.col("item_id") * 3 + F.col("x.j")).alias("needle_id"), F.col("x.t").alias("text"))
    return tx.literal_pairs(n, fx.table(spark, d, "documents").select(F.col("doc_id").alias("text_id"), "text"))


@query("select_text", "SELECT doc_id, lang || chr(10) || text AS text, CAST(length(lang) + 1 AS BIGINT) AS second_start, CAST(length(lang) + 1 + length(text) AS BIGINT) AS second_end FROM documents")
def select_text(spark, d):
    j = fx.table(spark, d, "documents").select("doc_id", F.to_json(F.struct("lang", F.struct(F.array("text", "source").alias("parts")).alias("body"))).alias("body"))
    o = tx.select_text(j, ["/lang", "/body/parts/0"])
    return o.select("doc_id", "text", F.col("ranges")[1]["start"].alias("second_start"), F.col("ranges")[1]["end"].alias("second_end"))


@query(
    "normalized_chars",
    rf"""WITH c AS (SELECT item_id, unnest(string_split(text, '')) AS ch, generate_subscripts(string_split(text, ''), 1) - 1 AS raw FROM benchmark)
     SELECT item_id, raw, ch, row_number() OVER (PARTITION BY item_id ORDER BY raw) - 1 AS pos FROM c WHERE NOT regexp_matches(ch, '{SPACE_RE}')""",
)
def normalized_chars(spark, d):
    return tx.normalized_chars(fx.table(spark, d, "benchmark"), ["item_id"])


def _pairs(spark, d):
    c = fx.table(spark, d, "conversations")
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("observed"))
    return c.join(nxt, ["conv_id", "turn"]).select(F.concat_ws(":", "conv_id", "turn").alias("pair_id"), F.col("text").alias("reference"), "observed")


@query(
    "text_equality",
    rf"""SELECT a.conv_id || ':' || a.turn AS pair_id, a.text = b.text AS raw_equal, regexp_replace(a.text, '{SPACE_RE}', '', 'g') = regexp_replace(b.text, '{SPACE_RE}', '', 'g') AS normalized_equal
     FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1""",
)
def text_equality(spark, d):
    return tx.text_equality(_pairs(spark, d))


@query(
    "compare_text",
    r"""WITH p AS (SELECT a.conv_id || ':' || a.turn AS k, regexp_split_to_array(trim(a.text), '\s+') AS ra, regexp_split_to_array(trim(b.text), '\s+') AS ob FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1),
     r AS (SELECT k, t, min(i) AS r FROM (SELECT k, unnest(ra) AS t, generate_subscripts(ra, 1) - 1 AS i FROM p) GROUP BY 1, 2 HAVING count(*) = 1),
     o AS (SELECT k, t, min(i) AS o FROM (SELECT k, unnest(ob) AS t, generate_subscripts(ob, 1) - 1 AS i FROM p) GROUP BY 1, 2 HAVING count(*) = 1),
     a AS (SELECT r.k, r, o, max(o) OVER (PARTITION BY r.k ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b4, min(o) OVER (PARTITION BY r.k ORDER BY r ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS af FROM r JOIN o ON r.k = o.k AND r.t = o.t),
     m AS (SELECT k, r, o FROM a WHERE (b4 IS NULL OR o > b4) AND (af IS NULL OR o < af) UNION ALL SELECT k, len(ra), len(ob) FROM p),
     g AS (SELECT k, coalesce(lag(r) OVER (PARTITION BY k ORDER BY r), -1) + 1 AS r0, r AS r1, coalesce(lag(o) OVER (PARTITION BY k ORDER BY r), -1) + 1 AS o0, o AS o1 FROM m)
     SELECT g.k AS pair_id, r0 AS ref_start, r1 AS ref_end, o0 AS obs_start, o1 AS obs_end, CASE WHEN r1 = r0 THEN 'insert' WHEN o1 = o0 THEN 'delete' ELSE 'replace' END AS kind
     FROM g JOIN p USING (k) WHERE (r1 > r0 OR o1 > o0) AND ra[r0+1:r1] <> ob[o0+1:o1]""",
)
def compare_text(spark, d):
    return tx.compare_text(_pairs(spark, d))


@query(
    "adjacent_similarity",
    sql(
        """b AS (SELECT *, regexp_replace(text, '\\W+', '', 'g') AS bare FROM segments), l AS (SELECT *, lag(segment_id) OVER w AS ps, lag(mode) OVER w AS pm, lag(bare) OVER w AS pb FROM b WINDOW w AS (PARTITION BY work_id ORDER BY ord)),
     s AS (SELECT work_id, segment_id, ps AS previous, 1 - levenshtein(bare, pb) / CAST(greatest(length(bare), length(pb)) AS DOUBLE) AS sim FROM l WHERE pm <> mode AND bare <> '' AND pb <> '')
     SELECT work_id, segment_id, previous, round(sim, 6) AS similarity FROM s WHERE sim >= 0.72""",
        "segments",
    ),
)
def adjacent_similarity(spark, d):
    return tx.adjacent_similarity(fx.segments(spark, d))


@query(
    "rule_duplication",
    sql(
        """b AS (SELECT *, regexp_replace(text, '\\W+', '', 'g') AS bare FROM segments), l AS (SELECT *, lag(segment_id) OVER w AS ps, lag(mode) OVER w AS pm, lag(bare) OVER w AS pb FROM b WINDOW w AS (PARTITION BY work_id ORDER BY ord)),
     s AS (SELECT work_id, segment_id, ps AS previous, 1 - levenshtein(bare, pb) / CAST(greatest(length(bare), length(pb)) AS DOUBLE) AS sim FROM l WHERE pm <> mode AND bare <> '' AND pb <> '')
     SELECT work_id, segment_id AS entity_id, 'warning' AS severity, previous AS evidence FROM s WHERE sim >= 0.5""",
        "segments",
    ),
)
def rule_duplication(spark, d):
    return qc.rule_duplication(fx.segments(spark, d), 0.5).select("work_id", "entity_id", "severity", "evidence")


@query(
    "search_terms",
    sql(
        """t AS (SELECT unit_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM units) SELECT unit_id, count(DISTINCT term) AS n_terms, min(term) AS first_term, max(term) AS last_term FROM t GROUP BY 1""",
        "units",
    ),
)
def search_terms(spark, d):
    return tx.terms(fx.units(spark, d)).groupBy("unit_id").agg(F.count(F.lit(1)).alias("n_terms"), F.min("term").alias("first_term"), F.max("term").alias("last_term"))


@query(
    "guard_query",
    r"""SELECT item_id, CASE WHEN g THEN 'alias' || CASE WHEN regexp_matches(t, '(?i)believ|secretly knew|intends? to|nelow') THEN '' ELSE '' END || CASE WHEN NOT regexp_matches(ev, '(?i)believ|secretly knew|intends? to') THEN ' ' || ev ELSE '' END
     ELSE t || ' ' || ev || ' alias' END AS query, g AS guarded FROM (SELECT *, regexp_matches(t || ' ' || ev || ' alias', '(?i)believ|secretly knew|intends? to') AS g FROM
     (SELECT item_id, CASE WHEN item_id % 3 = 0 THEN 'He believes ' || substr(text, 1, 20) ELSE text END AS t, CASE WHEN item_id % 2 = 0 THEN 'intends to leave' ELSE 'walks away' END AS ev FROM benchmark))""",
)
def guard_query(spark, d):
    i = F.col("item_id")
    r = fx.table(spark, d, "benchmark").select(
        "item_id", F.when(i % 3 == 0, F.concat(F.lit("He believes "), F.substring("text", 1, 20))).otherwise(F.col("text")).alias("change"),
        F.array(F.when(i % 2 == 0, "intends to leave").otherwise("walks away")).alias("events"), F.array(F.lit("alias")).alias("aliases"),
    )
    return tx.guard_query(r).select("item_id", "query", "guarded")


@query(
    "genre_profile",
    """SELECT p_partkey, CASE WHEN contains(g, 'comedy') THEN 'comedy' WHEN contains(g, 'action') OR contains(g, 'war') THEN 'action' WHEN contains(g, 'suspense') OR contains(g, 'thriller') THEN 'suspense'
     WHEN contains(g, 'romance') THEN 'romance' ELSE 'drama' END AS profile FROM (SELECT p_partkey, lower(p_name) || CASE WHEN p_size % 5 = 0 THEN ' Thriller' WHEN p_size % 7 = 0 THEN ' WARm' ELSE '' END AS g0, lower(lower(p_name) || CASE WHEN p_size % 5 = 0 THEN ' Thriller' WHEN p_size % 7 = 0 THEN ' WARm' ELSE '' END) AS g FROM part)""",
)
def genre_profile(spark, d):
    tail = F.when(F.col("p_size") % 5 == 0, " Thriller").when(F.col("p_size") % 7 == 0, " WARm").otherwise("")
    w = fx.table(spark, d, "part").select("p_partkey", F.concat(F.lower("p_name"), tail).alias("genres"))
    return tx.genre_profile(w).select("p_partkey", "profile")


@query(
    "preset_profile",
    """SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'romance' WHEN p_size % 3 = 1 THEN 'general' ELSE 'drama' END AS profile FROM part""",
)
def preset_profile(spark, d):
    genres = F.when(F.col("p_size") % 3 == 0, "文艺片").when(F.col("p_size") % 3 == 1, "纪录片").otherwise("Family DRAMA")
    return tx.genre_profile(fx.table(spark, d, "part").select("p_partkey", genres.alias("genres")), default="general", table=fixed.PRESET_KEYWORDS).select("p_partkey", "profile")


@query(
    "normalize_types",
    """WITH t AS (SELECT event_id, unnest(['Fight', event_type, CASE WHEN user_id % 2 = 0 THEN ' action ' ELSE 'Moral choice' END]) AS v, generate_subscripts([1, 2, 3], 1) AS i FROM events WHERE user_id % 5 <> 0),
     m AS (SELECT event_id, i, CASE replace(lower(trim(v)), ' ', '_') WHEN 'fight' THEN 'action' ELSE replace(lower(trim(v)), ' ', '_') END AS v FROM t),
     f AS (SELECT event_id, v, min(i) AS i FROM m WHERE v IN ('action', 'moral_choice') GROUP BY 1, 2)
     SELECT event_id, string_agg(v, ',' ORDER BY i) AS types FROM f GROUP BY 1 UNION ALL SELECT event_id, 'character_definition' FROM events WHERE user_id % 5 = 0""",
)
def normalize_types(spark, d):
    e = fx.table(spark, d, "events")
    third = F.when(F.col("user_id") % 2 == 0, " action ").otherwise("Moral choice")
    t = F.when(F.col("user_id") % 5 == 0, F.array("event_type")).otherwise(F.array(F.lit("Fight"), F.col("event_type"), third))
    return tx.normalize_types(e.select("event_id", t.alias("types"))).select("event_id", F.array_join("types", ",").alias("types"))


@query(
    "resolve_constraints",
    """WITH w AS (SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'action' WHEN 'MACHINERY' THEN 'romance' ELSE 'general' END AS p, c_nationkey FROM customer),
     d(field, dflt) AS (VALUES ('first_highlight_deadline_sec','6'),('original_ratio_range','0.25,0.45'),('original_clip_range_sec','4,12'),('max_original_over_15s','2'),('micro_cycle_sec','12,25'),('reset_interval_sec','45,75'),('vo_chars_per_sec','4.2,5.2'),('allow_cta','false')),
     s(p, field, preset) AS (VALUES ('action','original_ratio_range','0.35,0.55'),('action','original_clip_range_sec','4,15'),('action','max_original_over_15s','4'),('romance','original_clip_range_sec','4,18'),('romance','max_original_over_15s','4'),('romance','micro_cycle_sec','16,30'),('romance','reset_interval_sec','50,90'),('romance','vo_chars_per_sec','3.8,4.8'))
     SELECT CAST(c_custkey AS VARCHAR) AS work_id, d.field, CASE WHEN d.field = 'micro_cycle_sec' AND c_nationkey < 5 THEN '10,20' ELSE coalesce(preset, dflt) END AS value,
     CASE WHEN d.field = 'micro_cycle_sec' AND c_nationkey < 5 THEN 'explicit_config' WHEN preset IS NOT NULL THEN 'genre:' || w.p ELSE 'default' END AS origin FROM w CROSS JOIN d LEFT JOIN s ON s.p = w.p AND s.field = d.field""",
)
def resolve_constraints(spark, d):
    c = fx.table(spark, d, "customer")
    p = F.when(F.col("c_mktsegment") == "BUILDING", "action").when(F.col("c_mktsegment") == "MACHINERY", "romance").otherwise("general")
    w = c.select(F.col("c_custkey").cast("string").alias("work_id"), p.alias("profile"))
    e = c.where("c_nationkey < 5").select(F.col("c_custkey").cast("string").alias("work_id"), F.lit("micro_cycle_sec").alias("field"), F.lit("10,20").alias("value"))
    return tx.resolve_constraints(w, e)


@query(
    "check_citations",
    """WITH s AS (SELECT doc_id, string_split(text, chr(10)) AS l, DATE '2024-01-01' + CAST(doc_id % 40 AS INTEGER) AS pub FROM documents),
     c AS (SELECT doc_id, 1 AS a, 1 + doc_id % 3 AS b, CASE WHEN doc_id % 4 = 0 THEN 'wrong' ELSE array_to_string(l[1:1 + doc_id % 3], chr(10)) END AS q, l, pub FROM s)
     SELECT doc_id AS citation_id, doc_id AS source_id, CASE WHEN pub > DATE '2024-02-01' THEN 'SOURCE_AFTER_CUTOFF' WHEN b > len(l) THEN 'LINE_RANGE' WHEN array_to_string(l[a:b], chr(10)) <> q THEN 'QUOTE_MISMATCH' WHEN trim(q) = '' THEN 'EMPTY_QUOTE' END AS rule_id
     FROM c WHERE pub > DATE '2024-02-01' OR b > len(l) OR array_to_string(l[a:b], chr(10)) <> q OR trim(q) = ''""",
)
def check_citations(spark, d):
    i = F.col("doc_id")
    s = fx.table(spark, d, "documents").select(i.alias("source_id"), "text", F.date_add(F.lit("2024-01-01").cast("date"), (i % 40).cast("int")).alias("published"))
    lines = F.slice(F.split("text", "\n", -1), 1, (1 + i % 3).cast("int"))
    c = fx.table(spark, d, "documents").select(
        i.alias("citation_id"), i.alias("source_id"), F.lit(1).alias("start_line"), (1 + i % 3).cast("int").alias("end_line"), F.when(i % 4 == 0, "wrong").otherwise(F.array_join(lines, "\n")).alias("quote")
    )
    return tx.check_citations(c, s, "2024-02-01")


@query(
    "strict_quotes",
    sql(
        WORDS
        + """, p AS (SELECT k.clip_id, k.start_us AS v0, k.end_us AS v1, c.cue_id, c.ord AS c_ord, c.text, c.start_us >= k.start_us AND c.end_us <= k.end_us AS whole FROM clips k JOIN cues c ON c.source_id = k.source_id AND c.start_us < k.end_us AND k.start_us < c.end_us),
     w AS (SELECT clip_id, p.cue_id, c_ord, string_agg(w.text, '' ORDER BY w.ord) AS text FROM p JOIN words w ON w.cue_id = p.cue_id AND c_ord % 2 = 0 AND w.start_us >= v0 AND w.end_us <= v1 WHERE NOT whole GROUP BY 1, 2, 3),
     a AS (SELECT clip_id, cue_id, c_ord, text FROM p WHERE whole UNION ALL SELECT * FROM w)
     SELECT clip_id, sha256(string_agg(text, ' ' ORDER BY c_ord)) AS quote_sha, count(*) AS n_cues FROM a GROUP BY 1""",
        "clips", "cues",
    ),
)
def strict_quotes(spark, d):
    q = tx.strict_quote(fx.clips(spark, d), fx.cues(spark, d), words(spark, d), "clip_id")[0]
    return q.select("clip_id", F.sha2("quote", 256).alias("quote_sha"), "n_cues")
