"""Line dedup: content-defined chunks of lines, removed where their bytes occur before, in DataFrame functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, joinable, written

KEY_ROWS = 500_000  # chunk keys (16 bytes each) that are broadcast; beyond, chunks are joined by key
RANGE_ROWS = 200_000  # sources with removed ranges that are broadcast; beyond, transcripts are joined by source
MULTIPLIER, MODULUS = 1_000_003, 4_294_967_291


def once(name: str, value: str, body: str) -> str:
    """SQL for ``body`` with ``value`` bound to ``name``: as a lambda's argument it is evaluated once a row.

    As a column of its own it would be put into the body's lambdas by the optimizer and
    evaluated for each element.
    """
    return f"transform(array({value}), {name} -> {body})[0]"


def line_chunks(transcripts: DataFrame, long_words: int) -> DataFrame:
    """(source_id, chunk, from_line, to_line, kind, text) of a text's chunks of lines.

    Lines without a word are in no chunk. Each content line has a hash, and a rolling one
    with that of the next line; a chunk starts where the rolling hash is less than both
    its neighbours, so that borders move with the lines and a chunk has two lines at least.
    A line of ``long_words`` words or more is a chunk of its own. A short line that is left
    alone, between long ones or at an end, is compared together with the chunk before it and
    with the one behind it (kinds p, n); alone in its text, with other such texts (kind w).
    """
    blank = r"[^\x20\x09-\x0D]".replace("\\", "\\\\")
    piece = "named_struct('chunk', x.chunk, 'from_line', x.from_line, 'to_line', x.to_line, 'kind', '{}', 'parts', {})"
    chunks = f"""flatten(transform(whole, (x, c) -> if(x.long OR size(x.parts) > 1, array({piece.format("c", "x.parts")}),
        filter(array(
            if(c > 0, {piece.format("p", "concat(whole[c - 1].parts, x.parts)")}, null),
            if(c < size(whole) - 1, {piece.format("n", "concat(x.parts, whole[c + 1].parts)")}, null),
            if(size(whole) = 1, {piece.format("w", "x.parts")}, null)), y -> y is not null))))"""
    for name, value in [
        ("whole", """transform(starts, (s, c) -> named_struct(
            'chunk', c, 'from_line', at[s], 'to_line', at[coalesce(get(starts, c + 1), size(at)) - 1], 'long', long[s],
            'parts', transform(slice(at, s + 1, coalesce(get(starts, c + 1), size(at)) - s), i -> lines[i])))"""),
        ("starts", """filter(transform(at, (x, j) -> j), j -> j = 0 OR long[j] OR get(long, j - 1)
            OR (j > 1 AND j < size(at) - 1 AND NOT get(long, j - 2) AND NOT get(long, j + 1) AND roll[j] < get(roll, j - 1) AND roll[j] < get(roll, j + 1)))"""),
        ("roll", f"transform(hash, (h, j) -> (h * {MULTIPLIER}L + coalesce(get(hash, j + 1), 0L)) % {MODULUS}L)"),
        ("long", f"transform(at, i -> regexp_count(lines[i], '{blank}+') >= {long_words})"),
        ("hash", "transform(at, i -> cast(conv(substr(md5(lines[i]), 1, 8), 16, 10) as bigint))"),
        ("at", f"filter(sequence(0, size(lines) - 1), i -> lines[i] rlike '{blank}')"),
        ("lines", "split(coalesce(text, ''), '\\n')"),
    ]:
        chunks = once(name, value, chunks)
    rows = transcripts.select("source_id", F.expr(chunks).alias("chunks"))
    one = rows.select("source_id", F.explode("chunks").alias("c"))
    return one.select("source_id", "c.chunk", "c.from_line", "c.to_line", "c.kind", F.array_join("c.parts", "\n").alias("text"))


def dedup_lines(transcripts: DataFrame, long_words: int = 50, carried: list[str] | None = None) -> DataFrame:
    """Transcripts without the line chunks that occur before.

    transcripts(source_id, text): a source's lines, one to a line of ``text``. Chunks of
    two or more lines, or one of at least ``long_words`` words, that are equal byte for
    byte to one with a smaller (source_id, chunk number) are removed, with the blank lines
    inside them. A lone short line goes where it and a neighbouring chunk, or a text that is
    that line alone, occur before. So of a text that occurs before no line with a word stays,
    and of a repeated passage at most the chunks at its ends.

    Returns per transcript row: source_id, n_lines, n_removed (lines), n_left (lines with a word that
    stay), text (the remaining lines), and the columns named in ``carried``.

    Null text counts as empty; an empty text is one empty line. Ties cannot occur within a
    source; rows that repeat a source_id are one source, and what is removed is removed
    from each. A null source_id comes first and is never removed from. An empty table
    gives an empty one; other columns are ignored. Only keys of 16 bytes are counted over
    all chunks; the texts of keys that occur once are not shuffled.
    """
    chunks = line_chunks(transcripts.where("source_id IS NOT NULL"), long_words).withColumn("key", F.unhex(F.md5(F.concat("kind", "text"))))
    again = written(chunks.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "keys")
    repeated = chunks.join(joinable(again, KEY_ROWS), "key", "left_semi")
    place = F.struct("source_id", "chunk")
    repeated = written(repeated, "repeated", compression="zstd")
    discard(again)
    # the grouping compares whole texts
    first = repeated.groupBy("key", "kind", "text").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    gone = repeated.join(first, ["key", "kind", "text"]).where(place != F.col("first")).select("source_id", "from_line", "to_line").distinct()
    ranges = written(gone.groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct("from_line", "to_line"))).alias("ranges")), "ranges")
    discard(repeated)
    left = once("lines", "split(coalesce(text, ''), '\\n')", """named_struct('n_lines', size(lines), 'left', if(ranges is null, lines,
        flatten(transform(sequence(0, size(ranges)), q -> slice(lines,
            if(q = 0, 0, get(ranges, q - 1).to_line + 1) + 1,
            if(q = size(ranges), size(lines), get(ranges, q).from_line) - if(q = 0, 0, get(ranges, q - 1).to_line + 1))))))""")
    blank = r"[^\x20\x09-\x0D]".replace("\\", "\\\\")
    found = transcripts.select("source_id", "text", *(carried or [])).join(joinable(ranges, RANGE_ROWS), "source_id", "left").select("source_id", F.expr(left).alias("r"), *(carried or []))
    return found.select(
        "source_id", F.col("r.n_lines").cast("long").alias("n_lines"), (F.col("r.n_lines") - F.size("r.left")).cast("long").alias("n_removed"),
        F.expr(f"size(filter(r.left, x -> x rlike '{blank}'))").cast("long").alias("n_left"), F.array_join("r.left", "\n").alias("text"),
        *(carried or []),
    )


SQL = """
WITH lines AS (
  SELECT doc_id, i - 1 AS pos, l[i] AS line, len(regexp_extract_all(l[i], '[^\\x20\\x09-\\x0D]+')) AS words
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents), LATERAL (SELECT unnest(range(1, len(l) + 1)) AS i)
), content AS (
  SELECT *, ('0x' || substr(md5(line), 1, 8))::BIGINT AS h, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS j FROM lines WHERE words > 0
), rolls AS (
  SELECT *, words >= 50 AS long, (h * 1000003 + coalesce(lead(h) OVER w, 0)) % 4294967291 AS r, count(*) OVER (PARTITION BY doc_id) AS size FROM content WINDOW w AS (PARTITION BY doc_id ORDER BY pos)
), bounds AS (
  SELECT *, CASE WHEN j = 1 OR long OR lag(long) OVER w THEN 1
      WHEN j > 2 AND j < size AND NOT lag(long, 2) OVER w AND NOT lead(long) OVER w AND r < lag(r) OVER w AND r < lead(r) OVER w THEN 1 ELSE 0 END AS b FROM rolls WINDOW w AS (PARTITION BY doc_id ORDER BY pos)
), numbered AS (SELECT *, sum(b) OVER (PARTITION BY doc_id ORDER BY pos) AS chunk FROM bounds
), whole AS (
  SELECT doc_id, chunk, min(pos) AS lo, max(pos) AS hi, string_agg(line, chr(10) ORDER BY pos) AS body, count(*) = 1 AND NOT bool_or(long) AS lone FROM numbered GROUP BY doc_id, chunk
), near AS (SELECT *, lag(body) OVER w AS before, lead(body) OVER w AS behind FROM whole WINDOW w AS (PARTITION BY doc_id ORDER BY chunk)
), chunks AS (
  SELECT doc_id, chunk, lo, hi, 'c' AS kind, body FROM near WHERE NOT lone
  UNION ALL SELECT doc_id, chunk, lo, hi, 'p', before || chr(10) || body FROM near WHERE lone AND before IS NOT NULL
  UNION ALL SELECT doc_id, chunk, lo, hi, 'n', body || chr(10) || behind FROM near WHERE lone AND behind IS NOT NULL
  UNION ALL SELECT doc_id, chunk, lo, hi, 'w', body FROM near WHERE lone AND before IS NULL AND behind IS NULL
), gone AS (SELECT DISTINCT doc_id, lo, hi FROM (SELECT *, row_number() OVER (PARTITION BY kind, body ORDER BY doc_id, chunk) AS k FROM chunks) WHERE k > 1
), marked AS (
  SELECT n.doc_id, n.pos, n.line, n.words, g.lo IS NOT NULL AS out FROM lines n LEFT JOIN gone g ON n.doc_id = g.doc_id AND n.pos BETWEEN g.lo AND g.hi
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE out) AS n_removed, count(*) FILTER (WHERE NOT out AND words > 0) AS n_left,
  coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT out), '') AS text FROM marked GROUP BY doc_id
"""
