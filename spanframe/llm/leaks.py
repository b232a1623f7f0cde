"""Benchmark decontamination by Wu-Manber multi-pattern search over word codes."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, discard, plain_words, raw_text, written

CHUNK = 256  # window ends that one lane of the scan visits


class ShiftTable:
    """Wu-Manber tables for patterns of one length.

    A block is two consecutive words (one, if the patterns have one word). ``keys`` and
    ``shift`` tell how far a window whose last block is known may move; blocks with shift
    0 end some pattern, and ``order`` groups the patterns by that block.
    """

    def __init__(self, patterns: np.ndarray, owners: np.ndarray, base: int):
        self.m, self.base = patterns.shape[1], base
        self.b = min(2, self.m)
        blocks = self.codes(patterns, self.b)  # one column for each block of a pattern
        flat, move = blocks.ravel(), np.tile(np.arange(blocks.shape[1])[::-1], len(patterns))
        by = np.lexsort((move, flat))
        self.keys, first = np.unique(flat[by], return_index=True)
        self.shift = move[by][first]
        self.most = self.m - self.b + 1
        ends = blocks[:, -1]
        order = np.argsort(ends, kind="stable")
        self.patterns, self.owners, self.ends = patterns[order], owners[order], ends[order]

    def codes(self, ids: np.ndarray, b: int) -> np.ndarray:
        return ids.astype(np.int64) if b == 1 else ids[..., :-1].astype(np.int64) * self.base + ids[..., 1:]

    def search(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Window starts and owners of all occurrences in ``ids`` (0: a word of no pattern)."""
        lanes = np.arange(0, len(ids), CHUNK)
        stop = np.minimum(lanes + CHUNK, len(ids))
        at = np.maximum(lanes, self.m - 1)
        found = []
        live = at < stop
        at, stop = at[live], stop[live]
        while len(at):
            block = ids[at].astype(np.int64) if self.b == 1 else ids[at - 1].astype(np.int64) * self.base + ids[at]
            k = np.minimum(np.searchsorted(self.keys, block), len(self.keys) - 1)
            move = np.where(self.keys[k] == block, self.shift[k], self.most)
            found.append(at[move == 0])
            at = at + np.maximum(move, 1)
            live = at < stop
            at, stop = at[live], stop[live]
        ends = np.concatenate(found) if found else np.zeros(0, np.int64)
        return self.confirm(ids, ends)

    def confirm(self, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Compare the patterns of each end's bucket word by word, in bounded slices."""
        starts, owners = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        block = ids[ends].astype(np.int64) if self.b == 1 else ids[ends - 1].astype(np.int64) * self.base + ids[ends]
        lo, hi = np.searchsorted(self.ends, block, "left"), np.searchsorted(self.ends, block, "right")
        size = np.cumsum(hi - lo)
        for cut in range(0, int(size[-1]) if len(size) else 0, 1_000_000):
            pair = np.arange(cut, min(cut + 1_000_000, int(size[-1])))
            e = np.searchsorted(size, pair, "right")
            p = lo[e] + pair - (size[e] - (hi - lo)[e])
            first = ends[e] - self.m + 1
            same = (ids[first[:, None] + np.arange(self.m)] == self.patterns[p]).all(1)
            starts.append(first[same])
            owners.append(self.owners[p[same]])
        return np.concatenate(starts), np.concatenate(owners)


def tables(block: list[tuple[int, list[bytes]]], window: int) -> tuple[dict[bytes, int], list[ShiftTable]]:
    """Word codes, and shift tables by pattern length, for the windows of some cases."""
    vocab: dict[bytes, int] = {}
    rows: dict[int, list] = defaultdict(list)
    for owner, words in block:
        codes = [vocab.setdefault(w, len(vocab) + 1) for w in words]
        m = min(window, len(codes))
        rows[m] += [(codes[i : i + m], owner) for i in range(len(codes) - m + 1)]
    return vocab, [ShiftTable(np.array([r[0] for r in x], np.int32), np.array([r[1] for r in x], np.int64), len(vocab) + 1) for x in rows.values()]


def scan(vocab: dict[bytes, int], searches: list[ShiftTable], names: list[str]):
    def step(batches: Iterator[dict[str, list]]):
        get = vocab.get
        for b in batches:
            ids, bounds = [], [0]
            for raw in b["raw"]:
                ids += [get(w, 0) for w in plain_words(raw)]
                ids.append(0)  # no window crosses a text
                bounds.append(len(ids))
            codes, begin = np.array(ids, np.int32), np.array(bounds)
            hits: dict[int, list] = defaultdict(list)
            for s in searches:
                at, owner = s.search(codes)
                for d, a, o in zip((np.searchsorted(begin, at, "right") - 1).tolist(), at.tolist(), owner.tolist(), strict=True):
                    hits[d].append((a - bounds[d], a - bounds[d] + s.m, names[o]))
            spans, cases = [], []
            for d in range(len(b["raw"])):
                out: list[list[int]] = []
                for s, e, _ in sorted(hits.get(d, ())):
                    if out and s <= out[-1][1]:
                        out[-1][1] = max(out[-1][1], e)
                    else:
                        out.append([s, e])
                spans.append([{"start_word": s, "end_word": e} for s, e in out])
                cases.append(sorted({n for _, _, n in hits.get(d, ())}))
            yield {"row_no": b["row_no"], "segment_id": b["segment_id"], "n_words": (np.diff(begin) - 1).tolist(), "spans": spans, "case_ids": cases}

    return step


def find_leaks(segments: DataFrame, cases: DataFrame, window: int = 10, block_windows: int = 200_000) -> DataFrame:
    """Which narration segments repeat passages of held-out evaluation cases, and where.

    segments(segment_id, text): one row each, of any length. cases(case_id, text): the
    frozen cases. A window is ``window`` consecutive words of a case, or the whole case
    if it is shorter.

    Returns per segment row: segment_id, n_words, spans (array of start_word, end_word,
    half-open, merged: words inside any occurrence), case_ids (sorted, distinct).

    The cases are read in blocks of at most ``block_windows`` windows; each block's tables
    are one broadcast of bounded size and one pass over the segments. Beyond one block the
    segments are written once with a row number, by which the passes are merged: rows that
    share a segment_id, or have none, stay apart whatever the number of blocks.

    Null or empty text has no words: no spans. A null case id or a case without words
    is no pattern. Repeated segments give repeated rows; repeated cases change nothing.
    No cases: every segment clean. Other columns are ignored.
    """
    kind = segments.schema["segment_id"].dataType.simpleString()
    schema = f"row_no bigint, segment_id {kind}, n_words bigint, spans array<struct<start_word:bigint,end_word:bigint>>, case_ids array<string>"
    given = cases.where("case_id IS NOT NULL").select(F.col("case_id").cast("string").alias("case_id"), raw_text("text").alias("raw"))
    searches, block, names, held = [], [], [], 0

    def add() -> None:
        shared = segments.sparkSession.sparkContext.broadcast((*tables(block, window), list(names)))

        def step(batches, shared=shared):
            return scan(*shared.value)(batches)

        searches.append(step)

    for row in given.toLocalIterator():
        words = plain_words(row.raw)
        if words:
            block.append((len(names), words))
            names.append(row.case_id)
            held += max(1, len(words) - window + 1)
        if held >= block_windows:
            add()
            block, names, held = [], [], 0
    if block or not searches:
        add()
    texts = segments.select(F.monotonically_increasing_id().alias("row_no"), F.col("segment_id"), raw_text("text").alias("raw"))
    if len(searches) == 1:
        return arrow_map(texts, schema, searches[0]).drop("row_no")
    texts = written(texts, "segments", compression="zstd")
    every = arrow_map(texts, schema, searches[0])
    for step in searches[1:]:
        every = every.union(arrow_map(texts, schema, step))
    joined = every.groupBy("row_no").agg(
        F.first("segment_id").alias("segment_id"), F.max("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("parts"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("case_ids")))).alias("case_ids"),
    )
    merged = F.expr("""aggregate(parts, cast(array() as array<struct<start_word:bigint,end_word:bigint>>), (a, s) ->
        if(size(a) > 0 and s.start_word <= a[size(a)-1].end_word,
           concat(slice(a, 1, size(a)-1), array(named_struct('start_word', a[size(a)-1].start_word, 'end_word', greatest(a[size(a)-1].end_word, s.end_word)))),
           concat(a, array(s))))""")
    out = written(joined.select("segment_id", "n_words", merged.alias("spans"), "case_ids"), "leaks")
    discard(texts)
    return out
