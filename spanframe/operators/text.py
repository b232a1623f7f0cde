"""Caption and text operators: tokens, timing, cue building, literal and quote checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanframe.functions import fixed
from spanframe.functions import text as tx
from spanframe.functions.clock import half_even, wide
from spanframe.operators.timeline import consume_visuals, nominal_timeline
from spanframe.plans import findings as fd
from spanframe.plans.bins import BIN_US, interval_join
from spanframe.plans.ordered import by_rows, scan
from spanframe.plans.rounds import written

RELIABLE = ["asr", "aligned"]


def tokenize(cues: DataFrame) -> DataFrame:
    """TX1: one row per token with its 0-based position."""
    return cues.select(*[c for c in cues.columns if c != "text"], F.posexplode(tx.tokens("text")).alias("pos", "token"))


def spread_words(cues: DataFrame, floor_us: int = 1000) -> DataFrame:
    """TX2: estimated word times, proportional to token weight inside each cue.

    No word is shorter than ``floor_us``: one that would be is stretched (``below_floor``), the
    words behind it share what is left of the cue, and where nothing is left they follow
    past its end.  A cue's tokens stay in its row, so nothing is shuffled.
    """
    t = cues.where("end_us > start_us").withColumn("__t", tx.tokens("text")).withColumn("__w", F.transform("__t", tx.token_weight))
    natural = "2 * (end_us - a.base) * (a.upto + w) + a.left"
    at = f"a.base + ({natural}) div (2 * a.left) - if(({natural}) % (2 * a.left) = 0 AND (({natural}) div (2 * a.left)) % 2 <> 0, 1L, 0L)"  # ties to even
    state = "named_struct('at', {0}, 'base', {1}, 'left', {2}, 'upto', {3}, 'out', concat(a.out, array(named_struct('s', a.at, 'e', {0}, 'f', {4}))))"
    pushed, plain = f"(a.at + {floor_us}L)", "m"
    step = f"if(m - a.at < {floor_us}L, {state.format(pushed, pushed, 'a.left - a.upto - w', '0L', 'true')}, {state.format(plain, 'a.base', 'a.left', 'a.upto + w', 'false')})"
    start = "named_struct('at', start_us, 'base', start_us, 'left', aggregate(__w, 0L, (x, y) -> x + y), 'upto', 0L, 'out', cast(array() as array<struct<s:bigint,e:bigint,f:boolean>>))"
    times = F.expr(f"aggregate(__w, {start}, (a, w) -> transform(array({at}), m -> {step})[0]).out")
    t = t.select("source_id", "cue_id", F.posexplode(F.arrays_zip(F.col("__t").alias("text"), times.alias("at"))).alias("pos", "x"))
    return t.select(
        "source_id", "cue_id", F.col("pos").cast("bigint").alias("ord"), F.col("x.at.s").alias("start_us"), F.col("x.at.e").alias("end_us"), F.col("x.text").alias("text"),
        F.lit("estimated").alias("timing"), F.col("x.at.f").alias("below_floor"),
    )


def group_words(words: DataFrame, keys: list[str], max_chars: int, long_us: int = 3_200_000, soft_us: int = 900_000, min_us: int = 500_000, floor_us: int = 40_000) -> DataFrame:
    """TX6: cues from word times; a fold over one segment's words, then the end clamp.

    ``words``: keys, ord, text, start_us, dur_us relative to the segment, audio_us.
    All groups here hold the words of one segment.
    """
    item = F.struct(
        F.col("ord").alias("o"), F.col("start_us").alias("s"), F.greatest(F.col("dur_us"), F.lit(floor_us).cast("bigint")).alias("d"), tx.strip("text").alias("t")
    )
    rows = words.where(tx.strip("text") != "").groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("w"), F.max("audio_us").alias("audio_us"))

    def step(acc, x):
        """State: one 0/1 mark per word (1 opens a cue), start and size of the open cue."""
        units = tx.visible_units(x["t"])
        run = x["s"] + x["d"] - acc["s"]
        cut = (acc["n"] + units > max_chars) | (run > long_us) | (x["t"].rlike(tx.CUE_END) & (run >= soft_us))
        cut = cut | (acc["m"] == "")
        return F.struct(
            F.concat(acc["m"], F.when(cut, "1").otherwise("0")).alias("m"),
            F.when(cut, x["s"]).otherwise(acc["s"]).alias("s"),
            F.when(cut, units).otherwise(acc["n"] + units).alias("n"),
        )

    zero = F.lit(0).cast("bigint")
    marks = F.aggregate("w", F.struct(F.lit("").alias("m"), zero.alias("s"), zero.alias("n")), step, lambda a: a["m"])
    x = rows.withColumn("m", marks).select(*keys, "audio_us", "m", F.posexplode("w").alias("i", "x"))
    by_seg = Window.partitionBy(*keys)
    x = x.withColumn("n", F.sum((F.substring(F.col("m"), F.col("i") + 1, F.lit(1)) == "1").cast("int")).over(by_seg.orderBy("i").rowsBetween(Window.unboundedPreceding, 0)))
    g = x.groupBy(*keys, "audio_us", "n").agg(
        F.min_by("x.s", "i").alias("s"), F.max_by(F.col("x.s") + F.col("x.d"), "i").alias("e"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "x.t"))), lambda y: y["t"]), "").alias("text"),
    )
    end = F.least(F.col("audio_us"), F.greatest(F.col("e"), F.col("s") + min_us))
    end = F.least(end, F.lead("s").over(by_seg.orderBy("n")))
    return g.select(*keys, (F.col("n") - 1).cast("bigint").alias("ord"), F.col("s").alias("start_us"), end.alias("end_us"), tx.strip("text").alias("text")).where(
        "end_us > start_us and text <> ''"
    )


def spread_cues(segments: DataFrame, keys: list[str], max_chars: int, dur: str = "dur_us") -> DataFrame:
    """TX7: caption chunks of a text, timed by their visible units."""
    chunks = segments.withColumn("c", tx.split_caption("text", max_chars)).where(F.col(dur) > 0)
    sizes = F.transform("c", lambda s: F.greatest(F.lit(1).cast("bigint"), tx.visible_units(s)))
    none = F.array().cast("array<bigint>")
    # a text's chunks stay in its row: running sums, then one row a chunk
    upto = F.aggregate(sizes, none, lambda a, x: F.concat(a, F.array(F.coalesce(F.element_at(a, F.when(F.size(a) > 0, F.size(a)).otherwise(F.lit(None))), F.lit(0).cast("bigint")) + x)))
    rows = chunks.withColumn("__u", upto).withColumn("__all", F.element_at("__u", F.when(F.size("__u") > 0, F.lit(-1))))
    rows = rows.select(*keys, F.col(dur), "__all", "__u", F.posexplode("c").alias("n", "text"))

    def at(w):
        return half_even(wide(F.col(dur), w), "__all")

    before = F.coalesce(F.get("__u", F.col("n") - 1), F.lit(0).cast("bigint"))
    return rows.select(*keys, F.col("n").cast("bigint").alias("ord"), at(before).alias("start_us"), at(F.get("__u", F.col("n"))).alias("end_us"), "text").where("end_us > start_us")


def original_cues(segments: DataFrame, visuals: DataFrame, cues: DataFrame, words: DataFrame, slack_us: int = 1000, bin_us: int = BIN_US) -> DataFrame:
    """TX8: dialogue under the played visuals of original segments, on segment time.

    A cue inside the visual is kept whole; of a cut cue only reliably timed words
    inside the visual are kept; otherwise it is left out.
    """
    orig = segments.where("mode = 'original'")
    v = consume_visuals(orig, visuals).select(
        "work_id", "segment_id", F.col("ord").alias("v_ord"), "source_id", F.col("start_us").alias("v_start_us"), F.col("end_us").alias("v_end_us"), "local_us"
    )
    v = written(v, "played_originals")  # read when bins are measured and by whole and cut cues
    c = cues.select("source_id", "cue_id", "text", "start_us", "end_us")
    p = interval_join(v, c, ["source_id"], a_span=("v_start_us", "v_end_us"), b_span=("start_us", "end_us"), bin_us=bin_us)
    whole = (F.col("start_us") >= F.col("v_start_us") - slack_us) & (F.col("end_us") <= F.col("v_end_us") + slack_us)
    cut = p.where(~whole).drop("text", "start_us", "end_us")
    w = words.where(F.col("timing").isin(RELIABLE)).select("source_id", "cue_id", "ord", F.col("text").alias("w_text"), "start_us", "end_us")
    inside = (F.col("start_us") >= F.col("v_start_us") - slack_us) & (F.col("end_us") <= F.col("v_end_us") + slack_us)
    part = cut.join(w, ["source_id", "cue_id"]).where(inside)
    ident = ["work_id", "segment_id", "v_ord", "source_id", "v_start_us", "v_end_us", "local_us", "cue_id"]
    part = part.groupBy(*ident).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "w_text"))), lambda x: x["w_text"]), "").alias("text"),
        F.min_by("start_us", "ord").alias("start_us"), F.max_by("end_us", "ord").alias("end_us"),
    )
    both = p.where(whole).select(*ident, "text", "start_us", "end_us", F.lit(False).alias("partial")).unionByName(part.withColumn("partial", F.lit(True)))
    lo = F.col("local_us") + F.greatest(F.lit(0), F.col("start_us") - F.col("v_start_us"))
    hi = F.col("local_us") + F.least("v_end_us", "end_us") - F.col("v_start_us")
    return both.where(tx.strip("text") != "").select("work_id", "segment_id", "cue_id", "v_ord", lo.alias("start_us"), hi.alias("end_us"), "text", "partial")


def wrap(c, line_chars: int):
    """Caption text broken into lines."""
    return F.array_join(tx.split_caption(c, line_chars), "\n")


def build_cues(segments: DataFrame, visuals: DataFrame, cues: DataFrame, words: DataFrame, boundaries: DataFrame, line_chars: int = 16, max_lines: int = 2) -> DataFrame:
    """TX9: all captions of a work: word-timed voice, estimated voice, original dialogue.

    ``boundaries``: work_id, segment_id, ord, text, start_us, dur_us of voiced words.
    """
    keys = ["work_id", "segment_id"]
    clock = nominal_timeline(segments, visuals)
    voice = clock.where("mode = 'voiceover'").withColumn("audio_us", F.coalesce(F.when(F.col("voice_us") > 0, F.col("voice_us")), F.col("planned_us")))
    b = boundaries.join(voice.select(*keys, "audio_us"), keys)
    timed = group_words(b, keys, line_chars * max_lines)
    rest = voice.join(timed.select(*keys).distinct(), keys, "left_anti")
    spread = spread_cues(rest, keys, line_chars * max_lines)
    orig = original_cues(segments, visuals, cues, words)
    at = clock.select(*keys, F.col("ord").alias("seg_ord"), F.col("out_start_us").alias("__at"))

    def put(df, kind):
        moved = df.select(*keys, "start_us", "end_us", wrap("text", line_chars).alias("text"), F.lit(kind).alias("kind")).join(at, keys)
        return moved.select("work_id", "seg_ord", "segment_id", (F.col("start_us") + F.col("__at")).alias("start_us"), (F.col("end_us") + F.col("__at")).alias("end_us"), "text", "kind")

    return fd.union([put(timed, "word"), put(spread, "spread"), put(orig, "original")])


def reading_profile(cues: DataFrame, max_lines: int = 2, max_line: int = 16, max_cps: int = 20, count_spaces: bool = False) -> DataFrame:
    """TX10: lines, longest line, code points and the exceeded limits of each caption."""
    n, longest, chars, over = tx.reading_limits("text", F.col("end_us") - F.col("start_us"), max_lines, max_line, max_cps, count_spaces)
    return cues.select("*", n.alias("n_lines"), longest.alias("longest_line"), chars.alias("n_chars"), F.array_join(over, ",").alias("exceeded"))


def literal_locks(locks: DataFrame, cues: DataFrame) -> DataFrame:
    """TX11: locks whose literal the named cue does not hold (``exact`` or ``contains``)."""
    j = locks.join(cues.select("cue_id", F.col("text").alias("__t")), "cue_id", "left")
    hit = F.when(F.col("match") == "exact", F.col("__t") == F.col("text")).otherwise(F.contains(F.col("__t"), F.col("text")))
    rule = F.when(F.col("__t").isNull(), "LOCK_CUE_UNKNOWN").when(~hit, "TARGET_LITERAL_MISMATCH")
    return j.withColumn("rule_id", rule).where("rule_id is not null").select("lock_id", "cue_id", "rule_id")


def literal_pairs(needles: DataFrame, texts: DataFrame, shingle: int = 4) -> DataFrame:
    """All (text_id, needle_id) where the text holds the needle literally.

    No cross join.  A needle is found by something the text must hold whole: a run of
    ``shingle`` inner words, else the rarest of its inner words, else the rarest of its
    parts of three code points (a shorter needle is its own).  How many texts hold a part is
    counted first, for the parts of needles only.  Candidates are then tested with ``contains``.
    """
    parts = F.split("text", r"\s+", -1)
    inner = F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0)))
    n = needles.where("text <> ''").select("needle_id", F.col("text").alias("needle"), inner.alias("in"))
    w = texts.select("text_id", F.filter(F.split("text", r"\s+"), lambda x: x != "").alias("w"))
    runs = F.array_distinct(
        F.transform(F.sequence(F.lit(0), F.size("w") - shingle), lambda i: F.xxhash64(*[F.get("w", i + j) for j in range(shingle)]))
    )
    a = w.where(F.size("w") >= shingle).select("text_id", F.explode(runs).alias("h"))
    na = n.where(F.size("in") >= shingle).select("needle_id", F.xxhash64(*[F.get("in", F.lit(j)) for j in range(shingle)]).alias("h"))

    def grams(text):
        """Parts of k code points; the list of code points is bound once, as a lambda's argument."""

        def of(k):
            def parts(chars):
                at = F.sequence(F.lit(0), F.greatest(F.size(chars) - 1, F.lit(0)))
                return F.transform(at, lambda i: F.when(i + k <= F.size(chars), F.concat(*[F.get(chars, i + j) for j in range(k)])))

            return F.transform(F.array(F.split(text, "")), parts)[0]

        return of

    def rarest(held: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Texts' parts that some needle has, and each needle's part that the fewest texts hold."""
        held = held.join(wanted.select("h").distinct(), "h", "left_semi")
        counts = held.groupBy("h").agg(F.count(F.lit(1)).alias("__n"))
        best = wanted.join(counts, "h", "left").groupBy("needle_id").agg(F.min(F.struct(F.coalesce("__n", F.lit(0)), "h")).alias("b"))
        return held, best.select("needle_id", F.col("b.h").alias("h"))

    b = w.select("text_id", F.explode(F.array_distinct("w")).alias("h"))
    nb = n.where((F.size("in") > 0) & (F.size("in") < shingle)).select("needle_id", F.explode(F.array_distinct("in")).alias("h"))
    of, mine = grams("text"), grams("needle")
    c = texts.select("text_id", F.explode(F.array_distinct(F.array_compact(F.concat(of(1), of(2), of(3))))).alias("h"))
    size = F.length("needle")
    own = F.when(size == 1, mine(1)).when(size == 2, mine(2)).otherwise(mine(3))
    nc = n.where(F.size("in") == 0).select("needle_id", F.explode(F.array_distinct(F.array_compact(own))).alias("h"))
    found = [(a, na), *[rarest(x, y) for x, y in ((b, nb), (c, nc)) if not y.isEmpty()]]  # no pass over texts for a kind that no needle has
    ids = fd.union([x.join(y, "h").select("text_id", "needle_id") for x, y in found]).distinct()
    full = ids.join(texts.select("text_id", F.col("text").alias("__t")), "text_id").join(needles.select("needle_id", F.col("text").alias("__n")), "needle_id")
    return full.where(F.contains("__t", "__n")).select("text_id", "needle_id")


def _json_path(pointer: str) -> str:
    """JSON pointer to a variant path; ``~0`` and ``~1`` are unescaped."""
    if pointer == "":
        return "$"
    if not pointer.startswith("/"):
        raise ValueError(f"JSON pointer required: {pointer}")
    out = "$"
    for part in pointer[1:].split("/"):
        key = part.replace("~1", "/").replace("~0", "~")
        out += f"[{key}]" if key.isdigit() else f"['{key}']" if not key.isidentifier() else f".{key}"
    return out


def select_text(docs: DataFrame, pointers: list[str], joiner: str = "\n", body: str = "body") -> DataFrame:
    """TX12: text at JSON pointers joined in order, with the range of each piece.

    A pointer that is missing or not text makes ``text`` NULL and is listed.
    """
    v = F.try_parse_json(F.col(body))
    piece = [F.when(F.schema_of_variant(F.try_variant_get(v, _json_path(p), "variant")) == "STRING", F.try_variant_get(v, _json_path(p), "string")) for p in pointers]
    parts = F.array(*piece)
    ranges, offset = [], F.lit(0).cast("bigint")
    for i, c in enumerate(piece):
        start = offset if i == 0 else offset + len(joiner)
        offset = start + F.length(c)
        ranges.append(F.struct(F.lit(pointers[i]).alias("pointer"), start.alias("start"), offset.alias("end")))
    missing = F.array_compact(F.array(*[F.when(c.isNull(), F.lit(p)) for p, c in zip(pointers, piece)]))
    ok = F.size(missing) == 0
    return docs.select(
        *[c for c in docs.columns if c != body], F.when(ok, F.array_join(parts, joiner)).alias("text"), F.when(ok, F.array(*ranges)).alias("ranges"), missing.alias("missing")
    )


def normalized_chars(docs: DataFrame, keys: list[str], mode: str = "whitespace-only") -> DataFrame:
    """TX13: code points kept by the normalisation with their original positions."""
    chars = F.transform(F.filter(F.split("text", ""), lambda c: c != ""), lambda c, i: F.struct(i.cast("bigint").alias("raw"), c.alias("ch")))
    if mode != "exact":
        chars = F.filter(chars, lambda x: ~x["ch"].rlike(tx.SPACE))
    return docs.select(*keys, F.posexplode(chars).alias("pos", "x")).select(*keys, F.col("pos").cast("bigint").alias("pos"), F.col("x.raw").alias("raw"), F.col("x.ch").alias("ch"))


def compare_text(pairs: DataFrame, key: str = "pair_id") -> DataFrame:
    """TX14: difference regions of reference and observed text, in token positions.

    Anchors are tokens that occur once on each side and cross no other anchor; the
    regions between neighbouring anchors are compared.  This is not the minimal edit
    script and not a character opcode list; it is another measure on purpose.
    """
    def side(c, n):
        t = pairs.select(key, F.posexplode(F.split(tx.strip(c), r"\s+")).alias("p", "token"))
        return t.groupBy(key, "token").agg(F.count(F.lit(1)).alias("n"), F.min("p").alias(n)).where("n = 1").drop("n")

    a = side("reference", "r").join(side("observed", "o"), [key, "token"])
    w = Window.partitionBy(key).orderBy("r")
    before = F.max("o").over(w.rowsBetween(Window.unboundedPreceding, -1))
    after = F.min("o").over(Window.partitionBy(key).orderBy(F.col("r").desc()).rowsBetween(Window.unboundedPreceding, -1))
    a = a.withColumn("__b", before).withColumn("__a", after)
    a = a.where((F.col("__b").isNull() | (F.col("o") > F.col("__b"))) & (F.col("__a").isNull() | (F.col("o") < F.col("__a")))).select(key, "r", "o")
    size = pairs.select(key, F.size(F.split(tx.strip("reference"), r"\s+")).alias("r"), F.size(F.split(tx.strip("observed"), r"\s+")).alias("o"))
    m = a.unionByName(size)
    r0 = F.coalesce(F.lag("r").over(w), F.lit(-1)) + 1
    o0 = F.coalesce(F.lag("o").over(w), F.lit(-1)) + 1
    g = m.select(key, r0.alias("ref_start"), F.col("r").alias("ref_end"), o0.alias("obs_start"), F.col("o").alias("obs_end"))
    g = g.where("ref_end > ref_start or obs_end > obs_start").join(pairs, key)

    def part(c, s, e):
        return F.slice(F.split(tx.strip(c), r"\s+"), F.col(s) + 1, F.col(e) - F.col(s))

    ra, ob = part("reference", "ref_start", "ref_end"), part("observed", "obs_start", "obs_end")
    kind = F.when(F.col("ref_end") == F.col("ref_start"), "insert").when(F.col("obs_end") == F.col("obs_start"), "delete").otherwise("replace")
    return g.where(ra != ob).select(key, "ref_start", "ref_end", "obs_start", "obs_end", kind.alias("kind"))


def text_equality(pairs: DataFrame, key: str = "pair_id") -> DataFrame:
    """TX14 head: raw equality and equality without white space."""
    squash = lambda c: F.regexp_replace(c, tx.SPACE, "")
    return pairs.select(key, (F.col("reference") == F.col("observed")).alias("raw_equal"), (squash("reference") == squash("observed")).alias("normalized_equal"))


def adjacent_similarity(segments: DataFrame, threshold: float = 0.72) -> DataFrame:
    """TX15: neighbouring segments of different mode with near-equal text.

    The measure is ``1 - levenshtein / longer length``, not a matching-blocks ratio.
    """
    bare = F.regexp_replace("text", r"(?U)\W+", "")
    s = scan(segments.withColumn("__bare", bare), ["work_id"], ["ord"], by_rows("ord"), lags={"__p": F.struct("segment_id", "mode", "__bare")})
    s = s.where((F.col("__p") .isNotNull()) & (F.col("__p.mode") != F.col("mode")) & (F.col("__bare") != "") & (F.col("__p.__bare") != ""))
    longest = F.greatest(F.length("__bare"), F.length("__p.__bare"))
    near = F.abs(F.length("__bare") - F.length("__p.__bare")) <= (1 - threshold) * longest + 1
    sim = F.when(near, 1 - F.levenshtein(F.col("__bare"), F.col("__p.__bare")) / longest)
    return s.withColumn("similarity", F.round(sim, 6)).where(sim >= threshold).select("work_id", "segment_id", F.col("__p.segment_id").alias("previous"), "similarity")


def terms(units: DataFrame, id_col: str = "unit_id") -> DataFrame:
    """TX16: distinct (unit, term) rows."""
    return units.select(id_col, F.explode(tx.terms("text")).alias("term"))


def guard_query(requests: DataFrame) -> DataFrame:
    """TX17: drop beat wording that asserts hidden knowledge; keep clean event wording.

    ``requests``: change, events (array), aliases (array).
    """
    full = F.array_join(F.flatten(F.array(F.array("change"), F.col("events"), F.col("aliases"))), " ")
    clean = F.array_join(F.concat("aliases", F.filter("events", lambda e: ~tx.asserts_hidden_state(e))), " ")
    hidden = tx.asserts_hidden_state(full)
    return requests.withColumn("query", F.when(hidden, clean).otherwise(full)).withColumn("guarded", hidden)


def genre_profile(works: DataFrame, col: str = "genres", default: str = "drama", table: list = fixed.GENRE_KEYWORDS) -> DataFrame:
    """TX18: profile of the first keyword list that matches.

    Weights use ``GENRE_KEYWORDS`` with the default ``drama``, constraint presets
    ``PRESET_KEYWORDS`` with the default ``general``.
    """
    t = F.lower(F.col(col))
    out = None
    for name, words in table:
        cond = reduce(lambda a, b: a | b, [F.contains(t, F.lit(w)) for w in words])
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return works.withColumn("profile", out.otherwise(default))


def normalized_types(c):
    """TX19 as a column: aliases mapped, unknown dropped, first occurrence order."""
    table = F.create_map(*[F.lit(x) for kv in fixed.TYPE_ALIASES.items() for x in kv])
    named = F.transform(c, lambda v: F.replace(F.lower(tx.strip(v)), F.lit(" "), F.lit("_")))
    mapped = F.transform(named, lambda v: F.coalesce(F.try_element_at(table, v), v))
    kept = F.array_distinct(F.filter(mapped, lambda v: v.isin(fixed.HIGHLIGHT_TYPES)))
    return F.when(F.size(kept) > 0, kept).otherwise(F.array(F.lit(fixed.DEFAULT_TYPE)))


def normalize_types(rows: DataFrame, col: str = "types") -> DataFrame:
    return rows.withColumn(col, normalized_types(F.col(col)))


def resolve_constraints(works: DataFrame, explicit: DataFrame) -> DataFrame:
    """TX20: explicit value > genre preset > default, with its origin.

    ``works(work_id, profile)``; ``explicit(work_id, field, value)``.
    """
    spark = works.sparkSession
    defaults = spark.createDataFrame(list(fixed.FORMAT_DEFAULTS.items()), "field string, dflt string")
    presets = spark.createDataFrame([(p, f, v) for p, m in fixed.GENRE_PRESETS.items() for f, v in m.items()], "profile string, field string, preset string")
    # both tables are fixed in size (8 and 10 rows)
    rows = works.select("work_id", "profile", F.explode(F.array(*[F.lit(f) for f in fixed.FORMAT_DEFAULTS])).alias("field"))
    rows = rows.join(F.broadcast(defaults), "field").join(F.broadcast(presets), ["profile", "field"], "left").join(explicit, ["work_id", "field"], "left")
    origin = F.when(F.col("value").isNotNull(), "explicit_config").when(F.col("preset").isNotNull(), F.concat(F.lit("genre:"), "profile")).otherwise("default")
    return rows.select("work_id", "field", F.coalesce("value", "preset", "dflt").alias("value"), origin.alias("origin"))


def check_citations(citations: DataFrame, sources: DataFrame, as_of) -> DataFrame:
    """TX21: quotes must equal the cited lines; sources must not be newer than ``as_of``."""
    s = sources.select("source_id", F.col("text").alias("__t"), F.col("published").alias("__d"))
    j = citations.join(s, "source_id", "left")
    lines = F.split("__t", "\n", -1)
    ok_range = (F.col("start_line") >= 1) & (F.col("start_line") <= F.col("end_line")) & (F.col("end_line") <= F.size(lines))
    body = F.array_join(F.slice(lines, F.col("start_line"), F.col("end_line") - F.col("start_line") + 1), "\n")
    rule = (
        F.when(F.col("__t").isNull(), "CITATION_SOURCE_UNKNOWN")
        .when(F.col("__d") > F.lit(as_of).cast("date"), "SOURCE_AFTER_CUTOFF")
        .when(~ok_range, "LINE_RANGE")
        .when(body != F.col("quote"), "QUOTE_MISMATCH")
        .when(tx.strip("quote") == "", "EMPTY_QUOTE")
    )
    return j.withColumn("rule_id", rule).where("rule_id is not null").select("citation_id", "source_id", "rule_id")


def strict_quote(spans: DataFrame, cues: DataFrame, words: DataFrame, span_id: str = "span_id", bin_us: int = BIN_US) -> tuple[DataFrame, DataFrame]:
    """TX22: the quote of each span, and findings for cut cues without reliable words."""
    s = spans.select("source_id", span_id, F.col("start_us").alias("v_start_us"), F.col("end_us").alias("v_end_us"))
    c = cues.select("source_id", "cue_id", F.col("ord").alias("c_ord"), "text", "start_us", "end_us")
    p = interval_join(s, c, ["source_id"], a_span=("v_start_us", "v_end_us"), b_span=("start_us", "end_us"), bin_us=bin_us)
    whole = (F.col("start_us") >= F.col("v_start_us")) & (F.col("end_us") <= F.col("v_end_us"))
    w = words.where(F.col("timing").isin(RELIABLE)).select("source_id", "cue_id", "ord", F.col("text").alias("w_text"), F.col("start_us").alias("w0"), F.col("end_us").alias("w1"))
    cut = p.where(~whole).drop("text")
    kept = cut.join(w, ["source_id", "cue_id"]).where((F.col("w0") >= F.col("v_start_us")) & (F.col("w1") <= F.col("v_end_us")))
    kept = kept.groupBy("source_id", span_id, "cue_id", "c_ord").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "w_text"))), lambda x: x["w_text"]), "").alias("text")
    )
    bad = cut.select("source_id", span_id, "cue_id").join(kept.select("source_id", span_id, "cue_id"), ["source_id", span_id, "cue_id"], "left_anti")
    pieces = p.where(whole).select("source_id", span_id, "cue_id", "c_ord", "text").unionByName(kept)
    quote = pieces.groupBy("source_id", span_id).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c_ord", "text"))), lambda x: x["text"]), " ").alias("quote"), F.count(F.lit(1)).alias("n_cues")
    )
    return quote, bad.withColumn("rule_id", F.lit("PARTIAL_DIALOGUE_WITHOUT_RELIABLE_WORD_TIMING"))
