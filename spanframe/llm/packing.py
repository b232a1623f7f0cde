"""Best-fit packing: length patterns fitted to the histogram by non-negative least squares."""

from __future__ import annotations

import json
import re
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, raw_text, written

SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""  # fixed value: the vocabulary's own split
LONG_BLANKS = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{1000,}")  # the split's own matcher would recurse over them
_ENCODERS: dict[str, object] = {}


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable bytes as themselves, the rest from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def by_ranks(ranks: dict[bytes, int]):
    """``encode(text) -> ids`` from a rank table; long runs of blanks are cut out before the split.

    The split takes a run but for its last blank as one piece, and goes on at that blank,
    or takes the whole run at the end of a text; so the ids are the same.
    """
    table = tiktoken.Encoding("records", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> list[int]:
        ids, at = [], 0
        for run in LONG_BLANKS.finditer(text):
            last = run.end() - (run.end() < len(text))
            ids += table.encode_ordinary(text[at : run.start()])
            ids += table._encode_single_piece(text[run.start() : last])
            at = last
        return ids + table.encode_ordinary(text[at:])

    return encode


def encoder(path: str):
    """``encode(text) -> ids`` of a byte-level BPE file, loaded once per worker.

    Where the ids follow the merge order, the same ids come faster from a rank table;
    other files are read by the ``tokenizers`` library. Special tokens' strings are
    ordinary text.
    """
    if path not in _ENCODERS:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, merges = model["vocab"], [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        ids = [vocab.get(a + b, -1) for a, b in merges]
        alphabet = byte_alphabet()
        if ids == list(range(256, 256 + len(ids))) and all(vocab.get(c, 256) < 256 for c in alphabet):
            ranks = {bytes(alphabet[c] for c in token): i for token, i in vocab.items() if i < 256 + len(ids)}
            _ENCODERS[path] = by_ranks(ranks)
        else:
            from tokenizers import Tokenizer

            t = Tokenizer.from_file(path)
            t.encode_special_tokens = True
            _ENCODERS[path] = lambda text: t.encode(text, add_special_tokens=False).ids
    return _ENCODERS[path]


def cut_transcripts(transcripts: DataFrame, tokenizer: str, length: int) -> DataFrame:
    """(source_id, row_no, piece, start, length, ids): ids as little-endian unsigned 32-bit."""
    kind = transcripts.schema["source_id"].dataType.simpleString()

    def step(batches: Iterator[dict[str, list]]):
        encode, at = encoder(tokenizer), TaskContext.get().partitionId() << 33
        for b in batches:
            for cut in range(0, len(b["raw"]), 256):
                out = {k: [] for k in ("source_id", "row_no", "piece", "start", "length", "ids")}
                for key, raw in zip(b["source_id"][cut : cut + 256], b["raw"][cut : cut + 256], strict=True):
                    ids = np.array([*encode((raw or b"").decode("utf-8", "replace")), 0], "<u4")
                    first = len(ids) % length or min(length, len(ids))
                    for piece, start in enumerate([0, *range(first, len(ids), length)]):
                        part = ids[start : first if piece == 0 else start + length]
                        for k, v in zip(out, (key, at, piece, start, len(part), part.tobytes()), strict=True):
                            out[k].append(v)
                    at += 1
                yield out

    texts = transcripts.select("source_id", raw_text("text").alias("raw"))
    return arrow_map(texts, f"source_id {kind}, row_no bigint, piece int, start bigint, length bigint, ids binary", step)


def enumerate_patterns(lengths: np.ndarray, full: int, per_length: int) -> np.ndarray:
    """Patterns of one to three pieces that fill a sequence exactly, or all but nearly.

    Rows of three lengths, 0 for none: for each length the pieces that fill it up as a
    pair, or the longest that fits, and ``per_length`` evenly spread triples.
    """
    present = np.zeros(full + 1, bool)
    present[lengths] = True
    longest = np.maximum.accumulate(np.where(present, np.arange(full + 1), 0))
    rows = [np.stack([lengths, longest[full - lengths], np.zeros_like(lengths)], 1)]
    picks = lengths[np.unique(np.linspace(0, len(lengths) - 1, min(per_length, len(lengths))).astype(int))]
    a = np.repeat(lengths, len(picks))
    b = np.tile(picks, len(lengths))
    rest = full - a - b
    ok = rest > 0
    c = np.where(ok, longest[np.maximum(rest, 0)], 0)
    rows.append(np.stack([a[ok], b[ok], c[ok]], 1))
    every = np.unique(np.sort(np.concatenate(rows), 1)[:, ::-1], axis=0)
    waste = full - every.sum(1)
    return every[waste <= full // 64]


def fit_counts(patterns: np.ndarray, histogram: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Non-negative least squares of pattern counts against the histogram.

    Projected steps with a diagonal scale: each pattern moves by the mean lack of its
    lengths over the number of patterns that share them.
    """
    used = patterns > 0
    share = np.maximum(np.bincount(patterns[used], minlength=len(histogram)), 1).astype(float)
    scale = np.where(used, share[patterns], 0).max(1)
    x = np.zeros(len(patterns))
    for _ in range(rounds):
        made = np.zeros(len(histogram))
        for j in range(3):
            np.add.at(made, patterns[:, j], x)
        lack = histogram - made
        lack[0] = 0
        x = np.maximum(0, x + np.where(used, lack[patterns], 0).sum(1) / (used.sum(1) * scale))
    return x


def best_fit(rest: dict[int, int], full: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing on counts: lengths with their counts into sequences with theirs."""
    open_: dict[int, list[list]] = {}  # free space -> [pieces, count]
    order: list[int] = []

    def put(free: int, pieces: tuple[int, ...], n: int) -> None:
        if free not in open_:
            open_[free] = []
            insort(order, free)
        open_[free].append([pieces, n])

    for size in sorted(rest, reverse=True):
        n = rest[size]
        while n:
            k = bisect_left(order, size)
            if k < len(order):
                free = order[k]
                pieces, had = open_[free].pop()
                if not open_[free]:
                    del open_[free]
                    order.pop(k)
                m = min(n, had)
                if had > m:
                    put(free, pieces, had - m)
                each = 1 if m == n else min(free // size, n // had)  # equal sequences are filled alike
                put(free - size * each, (*pieces, *[size] * each), m)
                n -= m * each
            else:
                each = full // size
                if n >= each:
                    put(full - each * size, (size,) * each, n // each)
                    n %= each
                if n:
                    put(full - n * size, (size,) * n, 1)
                    n = 0
    return [(p, n) for held in open_.values() for p, n in held]


def plan_sequences(histogram: dict[int, int], full: int, per_length: int = 24) -> list[tuple[tuple[int, ...], int]]:
    """Sequences as (lengths, repeats) that use each length exactly as often as it occurs.

    Exact pairs are fitted and rounded first, then on what is left pairs with a waste of at
    most 1/64, then exact triples; what is left goes into sequences by best fit. Patterns
    with the longest piece are rounded first, as long pieces have the fewest partners.
    The work depends on ``full``, not on the counts.
    """
    rest = np.zeros(full + 1, np.int64)
    for size, n in histogram.items():
        rest[size] = n
    made: Counter = Counter()
    if rest[full]:
        made[(full,)] = int(rest[full])
        rest[full] = 0
    for pieces, waste in ((2, 0), (2, full // 64), (3, 0)):
        lengths = np.flatnonzero(rest)
        if len(lengths) < 2:
            break
        patterns = enumerate_patterns(lengths, full, per_length)
        patterns = patterns[(full - patterns.sum(1) <= waste) & ((patterns > 0).sum(1) <= pieces)]
        if not len(patterns):
            continue
        x = fit_counts(patterns, rest.astype(float))
        for k in np.lexsort((-x, -patterns.sum(1), -patterns.max(1))):
            if x[k] <= 0.02:
                continue
            need = Counter(int(v) for v in patterns[k] if v)
            n = min(max(1, round(float(x[k]))), *(int(rest[v]) // m for v, m in need.items()))
            if n > 0:
                made[tuple(sorted(need.elements(), reverse=True))] += n
                for v, m in need.items():
                    rest[v] -= n * m
    made.update(dict_counts(best_fit({int(v): int(rest[v]) for v in np.flatnonzero(rest)}, full)))
    return sorted(made.items(), reverse=True)


def dict_counts(pairs: list[tuple[tuple[int, ...], int]]) -> Counter:
    out: Counter = Counter()
    for pieces, n in pairs:
        out[tuple(sorted(pieces, reverse=True))] += n
    return out


def slots(plan: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, ranks, pieces a sequence, first sequence, offset) for each length of each pattern."""
    out, ranks, sequence = [], Counter(), 0
    for pieces, n in plan:
        at = 0
        for size, m in Counter(pieces).items():
            out.append((size, ranks[size], n * m, m, sequence, at))
            ranks[size] += n * m
            at += size * m
        sequence += n
    return out


def pack_transcripts(transcripts: DataFrame, tokenizer: str, length: int = 2048, per_length: int = 24) -> tuple[DataFrame, DataFrame]:
    """Packs the token ids of transcripts into few sequences of at most ``length`` tokens.

    transcripts(source_id, text): one row each. Each text's ids are followed by id 0.
    Only longer ones are cut; the first piece may be shorter, all others are full.

    Returns two tables. Pieces: source_id, row_no, piece, start, length, ids (binary,
    little-endian unsigned 32-bit). Places: row_no, piece, sequence_id, offset; the
    pieces of a sequence stand one after the other from offset 0.

    Pieces are tokenised once and written to the shared folder; only lengths are
    shuffled. The driver sees the histogram of lengths (at most ``length`` rows) and
    plans repeats of length patterns; a piece's rank among those of its length, counted in
    hash buckets, picks its sequence by a join with the plan's slots.

    Null or empty text: one piece with id 0. Repeated rows are packed as often as they
    occur (row_no tells them apart). An empty table: no pieces. Other columns are ignored.
    """
    spark = transcripts.sparkSession
    pieces = written(cut_transcripts(transcripts, tokenizer, length), "pieces", compression="zstd")
    buckets = max(64, int(spark.conf.get("spark.sql.shuffle.partitions")))
    sizes = pieces.select("row_no", "piece", F.col("length").cast("int").alias("length"), F.pmod(F.xxhash64("row_no", "piece"), F.lit(buckets)).cast("int").alias("bucket"))
    counts = sizes.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = slots(plan_sequences(histogram, length, per_length))
    table = spark.createDataFrame(plan, "length int, first bigint, ranks bigint, each bigint, sequence bigint, at bigint")
    before = counts.select("length", "bucket", (F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("before"))
    rank = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("row_no", "piece")) - 1
    ranked = sizes.select("*", rank.alias("own")).join(before, ["length", "bucket"]).select("row_no", "piece", "length", (F.col("before") + F.col("own")).alias("rank"))
    placed = ranked.join(F.broadcast(table), (ranked["length"] == table["length"]) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("ranks")))
    place = F.col("rank") - F.col("first")
    return pieces, placed.select(
        "row_no", "piece", (F.col("sequence") + F.floor(place / F.col("each"))).cast("long").alias("sequence_id"),
        (F.col("at") + place % F.col("each") * ranked["length"]).cast("long").alias("offset"),
    )
