"""Text measures and splits used by captions, retrieval and rules."""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanframe.functions.clock import col

# Fixed patterns and weights; results depend on these exact values.
CJK = r"[\u3400-\u9fff]"
TOKEN = r"[\u3400-\u9fff]|[A-Za-z0-9]+(?:[-_.'’][A-Za-z0-9]+)*|[^\s]"
LIGHT_TOKEN = r"^[，。！？；：、,.!?;:]$"
LIGHT_WEIGHT = 1  # in quarters
WORD_WEIGHT = 4
UNIT_PUNCT = r"[，。！？；：,.!?;:]"
SENTENCE_SPLIT = r"(?<=[。！？!?；;，,])"
CUE_END = r"[。！？!?；;]$"
MARKUP = r"<[^>]+>|\{\\[^}]+\}"
HIDDEN_STATE = r"(?i)早就知道|心里|内心|动机|believ|secretly knew|intends? to"
REPLAY_LABEL = r"(?i)(\breplay\b|重放|回放)"
SEP = "\u0001"  # never part of a caption: removed as white space or control
# A character reference: numeric, or a name with or without its semicolon.
REFERENCE = r"&(?:#[xX][0-9a-fA-F]+;?|#[0-9]+;?|[^\t\n\f <&#;]{1,32};?)"
# The standard's names, from Python's own table; those that need no semicolon, longest first.
NAMED = html5
UNCLOSED = "^(?:" + "|".join(sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n))) + ")"
# Numbers that stand for another character: 0, carriage return, and the bytes of Windows-1252.
WINDOWS = {0: "\ufffd", 13: "\r"} | {c: bytes([c]).decode("cp1252", "replace").replace("\ufffd", chr(c)) for c in range(0x80, 0xA0)}
# White space as the reference counts it: ASCII plus the Unicode separators.
SPACE = r"[\s\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\x1c-\x1f]+"


def strip(c) -> Column:
    """Text without leading and trailing white space of any script (``trim`` only drops blanks)."""
    return F.regexp_replace(col(c), rf"\A{SPACE}|{SPACE}\z", "")


def squeeze(c) -> Column:
    return F.trim(F.regexp_replace(col(c), SPACE, " "))


def _numbered(ref) -> Column:
    """The character of a numeric reference ``#...``: none for those that are no characters, U+FFFD out of range."""
    body = F.lower(F.regexp_extract(ref, "[xX]?[0-9a-fA-F]+", 0))
    digits = F.regexp_replace(body, "^x?0*(?=.)", "")
    read = F.when(body.startswith("x"), F.conv(digits, 16, 10)).otherwise(F.conv(digits, 10, 10)).cast("bigint")
    code = F.when(F.length(digits) > 8, F.lit(0x110000)).otherwise(read)
    windows = F.create_map(*[F.lit(x) for c, v in WINDOWS.items() for x in (c, v)])
    void = code.between(1, 8) | (code == 11) | code.between(14, 31) | (code == 127) | code.between(0xFDD0, 0xFDEF) | ((code % 0x10000) >= 0xFFFE)
    valid = (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    char = F.decode(F.unhex(F.lpad(F.hex(F.when(valid, code).otherwise(F.lit(0xFFFD))), 8, "0")), "UTF-32")
    return F.coalesce(F.try_element_at(windows, code.cast("int")), F.when(void & valid, "").otherwise(char))


def unescape(c) -> Column:
    """Character references as their characters, each once: names of the whole standard, decimal and hexadecimal ones.

    The text is cut at the references, so what a reference yields is never read as one
    again.  A name without semicolon counts if the standard lets it, also before more letters.
    """
    c = col(c)
    names = F.from_json(F.lit(json.dumps(NAMED)), "map<string,string>")

    def named(body):
        start = F.regexp_extract(body, UNCLOSED, 0)
        rest = F.substring(body, F.length(start) + 1, F.length(body))
        partly = F.when(start != "", F.concat(F.try_element_at(names, start), rest))
        return F.coalesce(F.try_element_at(names, body), partly, F.concat(F.lit("&"), body))

    parts = F.split(c, REFERENCE, -1)
    bodies = F.transform(F.regexp_extract_all(c, F.lit(REFERENCE), F.lit(0)), lambda r: F.substring(r, 2, F.length(r)))
    chars = F.transform(bodies, lambda b: F.when(b.startswith("#"), _numbered(b)).otherwise(named(b)))
    whole = F.array_join(F.flatten(F.zip_with(parts, chars, lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), "")
    return F.when(c.contains("&"), whole).otherwise(c)


def clean_text(c) -> Column:
    """Strip tags, decode character references once, turn ``\\N`` into a space, squeeze."""
    out = unescape(F.regexp_replace(col(c), MARKUP, ""))
    out = F.replace(F.replace(out, F.lit("\\N"), F.lit(" ")), F.lit("\\n"), F.lit(" "))
    return squeeze(out)


def tokens(c) -> Column:
    return F.regexp_extract_all(col(c), F.lit(TOKEN), F.lit(0))


def token_weight(c) -> Column:
    return F.when(col(c).rlike(LIGHT_TOKEN), F.lit(LIGHT_WEIGHT)).otherwise(F.lit(WORD_WEIGHT)).cast("bigint")


def visible_units(c) -> Column:
    """Code points that are not white space."""
    return F.length(F.regexp_replace(col(c), SPACE, "")).cast("bigint")


def text_units(c) -> Column:
    """CJK characters + Latin words + one per three punctuation marks."""
    c = col(c)
    return (
        F.regexp_count(c, F.lit(CJK))
        + F.regexp_count(c, F.lit("[A-Za-z0-9]+"))
        + F.floor(F.regexp_count(c, F.lit(UNIT_PUNCT)) / 3)
    ).cast("bigint")


def terms(c) -> Column:
    """Distinct search terms: lower-case alphanumeric words plus CJK bigrams."""
    c = col(c)
    words = F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))
    runs = F.regexp_extract_all(c, F.lit(r"[\u3400-\u9fff]+"), F.lit(0))
    grams = F.flatten(
        F.transform(
            runs,
            lambda r: F.transform(
                F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(r) - 1)),
                lambda i: F.substring(r, i, F.lit(2)),
            ),
        )
    )
    return F.array_distinct(F.concat(words, grams))


def asserts_hidden_state(c) -> Column:
    return col(c).rlike(HIDDEN_STATE)


def split_caption(c, max_chars: int) -> Column:
    """Pack sentences into chunks of at most ``max_chars`` visible units.

    Each sentence is measured once; one that alone exceeds the limit is cut every
    ``max_chars`` code points while the rest is still too long.  The packing is a fold
    over the sentences of one caption: (finished chunks, open chunk, its size).
    """
    if max_chars <= 0:
        raise ValueError("max_chars must be positive")
    pieces = F.filter(
        F.transform(F.split(squeeze(c), SENTENCE_SPLIT), lambda s: F.trim(s)), lambda s: s != ""
    )

    def measured(head, rest, units):
        return F.struct(head.alias("h"), rest.alias("r"), units.cast("int").alias("u"))

    def long_sentence(chars):
        # after squeezing the only white space is a single blank
        seen = F.filter(F.transform(chars, lambda ch, i: F.when(ch != " ", i)), lambda i: i.isNotNull())

        def cut(pos):
            k = F.floor(F.element_at(pos, -(max_chars + 1)) / max_chars).cast("int") + 1
            return F.transform(
                F.array(k),
                lambda n: measured(
                    F.array_join(
                        F.transform(
                            F.sequence(F.lit(0), n - 1),
                            lambda i: F.trim(F.array_join(F.slice(chars, i * max_chars + 1, F.lit(max_chars)), "")),
                        ),
                        SEP,
                    ),
                    F.array_join(F.slice(chars, n * max_chars + 1, F.greatest(F.size(chars) - n * max_chars, F.lit(0))), ""),
                    F.size(F.filter(pos, lambda p: p >= n * max_chars)),
                ),
            )[0]

        return F.transform(F.array(seen), cut)[0]

    def measure(s):
        units = F.length(F.replace(s, F.lit(" "), F.lit("")))
        chars = F.filter(F.split(s, ""), lambda ch: ch != "")
        return F.when(units <= max_chars, measured(F.lit(""), s, units)).otherwise(F.transform(F.array(chars), long_sentence)[0])

    def step(acc, x):
        fits = (x["h"] == "") & (acc["n"] + x["u"] <= max_chars)
        done = F.concat_ws(SEP, acc["done"], F.trim(acc["open"]), x["h"])
        return F.when(
            fits, F.struct(acc["done"].alias("done"), F.concat(acc["open"], x["r"]).alias("open"), (acc["n"] + x["u"]).alias("n"))
        ).otherwise(F.struct(done.alias("done"), x["r"].alias("open"), x["u"].alias("n")))

    # finished chunks are kept as one string: a growing array would be copied deeply
    start = F.struct(F.lit("").alias("done"), F.lit("").alias("open"), F.lit(0).alias("n"))
    out = F.aggregate(F.transform(pieces, measure), start, step, lambda acc: F.concat_ws(SEP, acc["done"], F.trim(acc["open"])))
    return F.filter(F.split(out, SEP), lambda s: s != "")


def reading_limits(text, duration_us, max_lines, max_line, max_cps, count_spaces=False):
    """(line count, longest line, code points, codes of exceeded limits) of a caption."""
    lines = F.split(col(text), "\n", -1)
    measure = (lambda s: F.length(s)) if count_spaces else (lambda s: visible_units(s))
    sizes = F.transform(lines, lambda s: measure(s).cast("bigint"))
    chars = F.aggregate(sizes, F.lit(0).cast("bigint"), lambda a, x: a + x)
    longest = F.array_max(sizes)
    n = F.size(lines).cast("bigint")
    over = F.array_compact(
        F.array(
            F.when(n > max_lines, F.lit("LINE_COUNT")),
            F.when(longest > max_line, F.lit("LINE_LENGTH")),
            F.when(chars * 1_000_000 > max_cps * col(duration_us), F.lit("READING_RATE")),
        )
    )
    return n, longest, chars, over
