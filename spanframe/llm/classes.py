"""LM scoring: Brown class-based bigrams, classes by exchange clustering, word counts over the whole corpus.

Every word but the most frequent has one row with all its neighbours (``contexts``), built
by one shuffle.  Neighbours of the head are named by rank, so their classes are an array in
every task and a round of moves shuffles nothing; neighbours outside the head are named by
their ending, and for the last table also by their code.
"""

from __future__ import annotations

import math
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import arrow_map, blank_words, discard, raw_text, written

FREQUENT, ENDINGS = 1_024, 256  # words with an item of their own; items of all others, by their last two characters
ITEMS = FREQUENT + ENDINGS + 1  # and one for the end of a text, which also stands before the first word
END = ITEMS - 1
HEAD = 200_000  # most frequent words whose counts and classes every task holds; those of others are joined
FLUSH = 250_000  # distinct words a task counts before it passes them on
TOKENS = 2_000_000  # tokens whose pairs a task counts before it passes them on
PAIRS = 200_000  # pairs of which a task makes rows at once
ENTRIES = 16_000  # neighbour counts whose moves are weighed at once
LEAST_GAIN = 0.01  # nats a token: a round of moves that gains less is the last
ITEM_BITS = 11  # low bits of a word's code: its item
TOP = (HEAD + 1) << ITEM_BITS  # codes below: ranks of head words, and the end; above: hashes of all others
NEARS = HEAD + 1 + ENDINGS  # names of neighbours: ranks of the head, the end, endings of all others
N_BITS = 13  # low bits of an entry: a count; above: twice the neighbour's name, plus one if it stands before the word
MOST = (1 << N_BITS) - 1
LONG = 1 << 22  # bytes of entries from which on a word's are summed by neighbour
END_CODE = HEAD << ITEM_BITS | END


@dataclass
class Model:
    """What scoring needs: frequent words' counts and classes, class tables in log10."""

    head: dict[bytes, tuple[int, float]]  # word -> class, log10(count + 0.5)
    unseen: np.ndarray  # item -> class of a word that the tasks do not hold, if training has not seen it
    move: np.ndarray  # class, class -> log10 probability
    total: np.ndarray  # class -> log10 of the emission's denominator
    end: float  # log10(count + 0.5) of the end


def item_of(word: bytes) -> int:
    """The item of a word without one of its own: its ending's."""
    return FREQUENT + zlib.crc32(word.decode("utf-8", "replace")[-2:].encode()) % ENDINGS


def code_of(word: bytes) -> int:
    """The code of a word outside the head. Words of equal code (52 bits) share their class, not their count."""
    return (xxhash.xxh64_intdigest(word) >> 13 | 1 << 51) << ITEM_BITS | item_of(word)


def word_counts(training: DataFrame) -> DataFrame:
    """(word, code, n) over all training texts, pre-aggregated in the tasks; codes as of words outside the head."""

    def step(batches: Iterator[dict[str, list]]):
        found: Counter = Counter()
        for b in batches:
            for raw in b["raw"]:
                found.update(blank_words(raw))
                if len(found) > FLUSH:
                    yield {"word": list(found), "n": list(found.values())}
                    found.clear()
        yield {"word": list(found), "n": list(found.values())}

    def name(batches: Iterator[dict[str, list]]):
        for b in batches:
            yield {**b, "code": [code_of(w) for w in b["word"]]}

    sums = arrow_map(training.select("raw"), "word binary, n bigint", step).groupBy("word").agg(F.sum("n").alias("n"))
    return arrow_map(sums, "word binary, code bigint, n bigint", name)


def head_words(counts: DataFrame, most: int) -> list[tuple[bytes, int]]:
    """The most frequent words, at most ``most``: all above a count that a histogram of counts gives."""
    level = F.floor(F.log2("n") * 16).cast("int")
    levels = sorted(((r.level, r.words) for r in counts.groupBy(level.alias("level")).agg(F.count("*").alias("words")).collect()), reverse=True)
    least, held = None, 0
    for at, words in levels:
        if held + words > most:
            break
        least, held = at, held + words
    if least is None:
        return []
    return sorted(((bytes(r.word), r.n) for r in counts.where(level >= least).collect()), key=lambda x: (-x[1], x[0]))


def head_code(rank: int, word: bytes) -> int:
    return rank << ITEM_BITS | (rank if rank < FREQUENT else item_of(word))


def binary(offsets: np.ndarray, values: np.ndarray) -> pa.Array:
    """A binary column of slices of ``values``, which start at ``offsets`` (in values)."""
    at = (offsets * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(at.tobytes()), pa.py_buffer(values.tobytes())])


def slices(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The offsets (in values) and values of a binary column."""
    size, (_, at, data) = np.dtype(kind).itemsize, column.buffers()
    offsets = np.frombuffer(at, np.int32)[column.offset : column.offset + len(column) + 1] // size if len(column) else np.zeros(1, np.int32)
    values = np.frombuffer(data, kind, offsets[-1]) if data is not None and offsets[-1] else np.zeros(0, kind)
    return offsets - offsets[0], values[offsets[0] :]


def entries_of(near: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed entries and the entry each comes from; counts over ``MOST`` make several."""
    parts = (n + MOST - 1) // MOST
    of = np.repeat(np.arange(len(n)), parts)
    last = np.cumsum(parts) - 1
    held = np.full(len(of), MOST)
    held[last] = n - MOST * (parts - 1)
    return (near[of] << N_BITS | held).astype("<u4"), of


def raw_texts(b: pa.RecordBatch) -> Iterator[bytes | None]:
    """The texts of a batch, a few of them as Python objects at a time."""
    for at in range(0, b.num_rows, 256):
        yield from b.column("raw").slice(at, 256).to_pylist()


def neighbour_rows(codes: list[int], chain: array, most: int = PAIRS) -> Iterator[pa.RecordBatch]:
    """(code, entries, others) of a task's words, in the order of their codes; ``chain`` has the places of its tokens' codes.

    The distinct pairs are held once; rows are made from about ``most`` of them at a time.
    """
    known, label = np.unique(np.array(codes, np.int64), return_inverse=True)
    c = label.astype(np.int32)[np.frombuffer(chain, np.int32)]
    pair = c[:-1].astype(np.int64)
    pair *= len(known)
    pair += c[1:]
    del c
    pair.sort()
    at = np.flatnonzero(np.diff(pair, prepend=-1))
    n = np.diff(at, append=len(pair)).astype(np.int32)
    pair = pair[at]
    a, b = (pair // len(known)).astype(np.int32), (pair % len(known)).astype(np.int32)
    del at, pair
    by_b = np.argsort(b, kind="stable").astype(np.int32)
    every = np.arange(len(known) + 1)
    a_at, b_at = np.searchsorted(a, every), np.append(0, np.cumsum(np.bincount(b, minlength=len(known))))
    rank, rare = known >> ITEM_BITS, known >= TOP
    name = np.where(rare, HEAD + 1 + (known & ((1 << ITEM_BITS) - 1)) - FREQUENT, rank)
    first = ~rare & ((rank < FREQUENT) | (rank == HEAD))
    ends, lo = a_at + b_at, 0  # pairs of the words up to each
    while lo < len(known):
        hi = min(max(lo + 1, int(np.searchsorted(ends, ends[lo] + most, "right")) - 1), lo + 20_000, len(known))
        behind, before = np.arange(a_at[lo], a_at[hi]), by_b[b_at[lo] : b_at[hi]]
        behind = behind[~first[a[behind]] | first[b[behind]]]
        before = before[~first[b[before]]]
        own = np.concatenate([a[behind], b[before]])
        near = np.concatenate([2 * name[b[behind]], 2 * name[a[before]] + 1])
        other = np.concatenate([np.where(rare[a[behind]] & rare[b[behind]], known[b[behind]], 0), np.zeros(len(before), np.int64)])
        packed, of = entries_of(near, np.concatenate([n[behind], n[before]]).astype(np.int64))
        own, other = own[of], other[of]
        order = np.argsort(own, kind="stable")
        own, packed, other = own[order], packed[order], other[order]
        far = other != 0
        cut = np.append(np.flatnonzero(np.diff(own, prepend=-1)), len(own))
        upto = np.append(0, np.cumsum(far))[cut]
        if len(own):
            yield pa.RecordBatch.from_arrays([pa.array(known[own[cut[:-1]]]), binary(cut, packed), binary(upto, other[far])], ["code", "entries", "others"])
        lo = hi


def neighbours(training: DataFrame, head: dict[bytes, int]) -> DataFrame:
    """(code, entries, others): neighbours of words over all training texts, a row per word and part of a task.

    ``entries`` are packed neighbours and counts. ``others`` are the codes of neighbours behind a
    word, where that and the word are both outside the head, in the order of their entries. The most
    frequent words and the end list only each other, and only behind them.
    """
    shared = training.sparkSession.sparkContext.broadcast(head)

    def step(batches: Iterator[pa.RecordBatch]):
        place: dict[bytes, int] = {}  # word -> place in the list of codes
        codes, chain = [END_CODE], array("i", [0])

        for b in batches:
            for raw in raw_texts(b):
                for w in blank_words(raw):
                    k = place.get(w)
                    if k is None:
                        k = place[w] = len(codes)
                        c = shared.value.get(w)
                        codes.append(code_of(w) if c is None else c)
                    chain.append(k)
                chain.append(0)
                if len(chain) > TOKENS or len(codes) > FLUSH:
                    yield from neighbour_rows(codes, chain)
                    place, codes, chain = {}, [END_CODE], array("i", [0])
        yield from neighbour_rows(codes, chain)

    return training.select("raw").mapInArrow(step, "code bigint, entries binary, others binary")


def contexts(rows: DataFrame) -> DataFrame:
    """(code, entries, others): one row per word, from its rows side by side.

    A word's entries that grow long are summed by neighbour, so they have at most twice
    ``NEARS`` neighbours besides those outside the head; words with a share of the tokens that could
    burden a task list only each other.
    """

    def short(code: int, packed: np.ndarray) -> np.ndarray:
        if packed.nbytes < LONG or code >= TOP:
            return packed
        sums = np.bincount(packed >> N_BITS, packed & MOST, 2 * NEARS).astype(np.int64)
        near = np.flatnonzero(sums)
        return entries_of(near, sums[near])[0]

    def step(batches: Iterator[pa.RecordBatch]):
        at, parts, others = None, [], []  # the last word of the batches so far

        def open_word():
            packed, far = short(at, np.concatenate(parts)), np.concatenate(others)
            return pa.RecordBatch.from_arrays([pa.array([at]), binary(np.array([0, len(packed)]), packed), binary(np.array([0, len(far)]), far)], ["code", "entries", "others"])

        for b in batches:
            if not b.num_rows:
                continue
            code = b.column("code").to_numpy()
            (e_at, e), (o_at, o) = slices(b.column("entries"), "<u4"), slices(b.column("others"), "<i8")
            starts = np.flatnonzero(np.diff(code, prepend=-1))
            ends = np.append(starts, len(code))
            first, last = 0, len(starts) - 1
            if at is not None and code[0] == at:
                parts.append(e[: e_at[ends[1]]])
                others.append(o[: o_at[ends[1]]])
                parts, others = [short(at, np.concatenate(parts))], [np.concatenate(others)]
                first = 1
            if first <= last:
                if at is not None:
                    yield open_word()
                if first < last:
                    cut = ends[first : last + 1]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(code[cut[:-1]]), binary(e_at[cut] - e_at[cut[0]], e[e_at[cut[0]] : e_at[cut[-1]]]), binary(o_at[cut] - o_at[cut[0]], o[o_at[cut[0]] : o_at[cut[-1]]]),
                    ], ["code", "entries", "others"])
                at, parts, others = int(code[ends[last]]), [e[e_at[ends[last]] : e_at[-1]].copy()], [o[o_at[ends[last]] : o_at[-1]].copy()]
        if at is not None:
            yield open_word()

    return rows.repartition("code").sortWithinPartitions("code").mapInArrow(step, "code bigint, entries binary, others binary")


def cells(parts: DataFrame, rows: int, columns: int) -> np.ndarray:
    """A table of fixed size from its tasks' sums (cell, n)."""
    out = np.zeros(rows * columns, np.int64)
    for r in parts.groupBy("cell").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r.cell] = r.n
    return out.reshape(rows, columns)


def summed(df: DataFrame, size: int, add) -> DataFrame:
    """(cell, n): what ``add(batch, sums)`` gathers in a task's array of ``size`` cells."""

    def step(batches: Iterator[pa.RecordBatch]):
        sums = np.zeros(size, np.int64)
        for b in batches:
            add(b, sums)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(sums[at])], ["cell", "n"])

    return df.mapInArrow(step, "cell bigint, n bigint")


def entries(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch of contexts: the row, neighbour and count of every entry."""
    at, packed = slices(b.column("entries"), "<u4")
    return np.repeat(np.arange(b.num_rows), np.diff(at)), (packed >> N_BITS).astype(np.int64), (packed & MOST).astype(np.int64)


def counted(near: np.ndarray) -> np.ndarray:
    """Entries that tell of a pair: words behind, and of those before only such as list no other words."""
    name = near >> 1
    return (near & 1 == 0) | (name < FREQUENT) | (name == HEAD)


def add_pairs(sums: np.ndarray, own: np.ndarray, near: np.ndarray, n: np.ndarray, groups: np.ndarray, k: int) -> None:
    """Adds entries of words of groups ``own`` to a table of ``k`` by ``k`` groups."""
    other, before = groups[near >> 1], near & 1 == 1
    cell = np.where(before, other * k + own, own * k + other)
    sums += np.bincount(cell, n, k * k).astype(np.int64)


def item_pairs(table: DataFrame) -> np.ndarray:
    """Counts of neighbouring items: a table of fixed size, from which the first classes come."""
    low = (1 << ITEM_BITS) - 1
    ranks = np.arange(HEAD)
    item_of_rank = np.full(HEAD, -1)
    item_of_rank[:FREQUENT] = ranks[:FREQUENT]
    names = {int(r.code) >> ITEM_BITS: int(r.code) & low for r in table.where(f"code < {HEAD << ITEM_BITS}").select("code").collect()}
    for rank, item in names.items():
        item_of_rank[rank] = item
    items = np.concatenate([np.maximum(item_of_rank, 0), [END], FREQUENT + np.arange(ENDINGS)])
    shared = table.sparkSession.sparkContext.broadcast(items)

    def add(b: pa.RecordBatch, sums: np.ndarray) -> None:
        row, near, n = entries(b)
        own = b.column("code").to_numpy() & low
        keep = counted(near)
        add_pairs(sums, own[row[keep]], near[keep], n[keep], shared.value, ITEMS)

    return cells(summed(table, ITEMS * ITEMS, add), ITEMS, ITEMS)


def weigh(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange(pairs: np.ndarray, n_classes: int, rounds: int = 15) -> np.ndarray:
    """Classes of items: each in turn moves to the class that raises the likelihood of class bigrams most.

    Settles the most frequent words, and gives the first classes of all others by their
    endings; ``settle_head`` and ``settle_rest`` go on with these.
    The end of a text keeps the last class for itself.
    """
    counts = pairs.astype(float)
    free = n_classes - 1
    order = np.argsort(-(counts.sum(1) + counts.sum(0)), kind="stable")
    order = order[order != END]
    classes = np.zeros(len(counts), np.int64)
    classes[order] = np.arange(len(order)) % free
    classes[END] = free
    table = np.zeros((n_classes, n_classes))
    np.add.at(table, (classes[:, None], classes[None, :]), counts)
    active = [w for w in order if counts[w].any() or counts[:, w].any()]
    for _ in range(rounds):
        moved = 0
        for w in active:
            a, loop = classes[w], counts[w, w]
            after = np.bincount(classes, counts[w], n_classes)
            before = np.bincount(classes, counts[:, w], n_classes)
            after[a] -= loop
            before[a] -= loop
            table[a] -= after
            table[:, a] -= before
            table[a, a] -= loop
            rows, columns = table.sum(1), table.sum(0)
            gain = (weigh(table + after) - weigh(table)).sum(1) + (weigh(table + before[:, None]) - weigh(table)).sum(0)
            own = np.diagonal(table)
            gain += weigh(own + after + before + loop) - weigh(own + after) - weigh(own + before) + weigh(own)
            out, into = after.sum() + loop, before.sum() + loop
            gain -= weigh(rows + out) - weigh(rows) + weigh(columns + into) - weigh(columns)
            b = int(np.argmax(gain[:free]))
            if gain[b] <= gain[a] + 1e-9:
                b = a
            classes[w] = b
            moved += b != a
            table[b] += after
            table[:, b] += before
            table[b, b] += loop
        if moved <= len(active) // 500:
            break
    return classes


def likelihood(table: np.ndarray) -> float:
    """Log likelihood of class bigrams, up to a constant."""
    return float(weigh(table).sum() - weigh(table.sum(0)).sum() - weigh(table.sum(1)).sum())


def best_classes(table: np.ndarray, classes: np.ndarray, after: np.ndarray, before: np.ndarray, loop: np.ndarray) -> np.ndarray:
    """The class for each word that raises the likelihood most when all others stay; never the last."""
    words, k = after.shape
    every = np.arange(words)
    gain = np.zeros((words, k))
    for near, far, t in ((after, before, table.T), (before, after, table)):
        r, j = np.nonzero(near)
        if not len(r):
            continue
        base, n, a = t[j], near[r, j], classes[r]
        inner = j == a  # the word's own counts are not in the table
        base[inner] -= far[r[inner]]
        base[np.arange(len(r)), a] -= n + inner * loop[r]
        first = np.flatnonzero(np.diff(r, prepend=-1))
        gain[r[first]] += np.add.reduceat(weigh(base + n[:, None]) - weigh(base), first)
    own = np.repeat(np.diagonal(table)[None, :], words, 0)
    own[every, classes] -= after[every, classes] + before[every, classes] + loop
    gain += weigh(own + after + before + loop[:, None]) - weigh(own + after) - weigh(own + before) + weigh(own)
    for sums, more in ((table.sum(1), after.sum(1) + loop), (table.sum(0), before.sum(1) + loop)):
        rest = np.repeat(sums[None, :], words, 0)
        rest[every, classes] -= more
        gain -= weigh(rest + more[:, None]) - weigh(rest)
    gain[:, -1] = -np.inf
    best = gain.argmax(1)
    return np.where(gain[every, best] > gain[every, classes] + 1e-9, best, classes)


def moves(table: np.ndarray, old: np.ndarray, row: np.ndarray, slot: np.ndarray, n: np.ndarray) -> np.ndarray:
    """New classes of the words of a batch, a bounded number of entries at a time; slots as classes behind, before, and the word itself."""
    k, new, at = len(table), old.copy(), 0
    ends = np.searchsorted(row, np.arange(len(old) + 1))
    while at < len(old):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + ENTRIES, "right")) - 1)
        to = min(to, at + ENTRIES // 8)
        part = slice(ends[at], ends[to])
        full = np.bincount((row[part] - at) * (2 * k + 1) + slot[part], n[part], (to - at) * (2 * k + 1)).reshape(to - at, 2 * k + 1)
        new[at:to] = best_classes(table, old[at:to], full[:, :k], full[:, k : 2 * k], full[:, 2 * k] / 2)
        at = to
    return new


def settle_head(table: DataFrame, endings: DataFrame, groups: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Classes by neighbour name once the head's words have moved, and the counts of neighbouring classes.

    In a round each half of the words, by rank, takes its best class given all others'; words
    outside the head stand in their ending's class. Rounds have no fixed number: they end
    when one gains less than ``LEAST_GAIN`` a token. A half that loses is undone.
    """
    spark, head = table.sparkSession, table.where(f"code < {TOP}")

    def counts(of: np.ndarray) -> np.ndarray:
        shared = spark.sparkContext.broadcast(of)

        def words(b: pa.RecordBatch, sums: np.ndarray) -> None:
            row, near, n = entries(b)
            own = shared.value[b.column("code").to_numpy() >> ITEM_BITS]
            keep = counted(near)
            add_pairs(sums, own[row[keep]], near[keep], n[keep], shared.value, k)

        def others(b: pa.RecordBatch, sums: np.ndarray) -> None:
            near, n = b.column("near").to_numpy(), b.column("n").to_numpy()
            add_pairs(sums, shared.value[b.column("name").to_numpy()], near, n, shared.value, k)

        return cells(summed(head, k * k, words).union(summed(endings, k * k, others)), k, k).astype(float)

    def round_of(of: np.ndarray, now: np.ndarray, half: int) -> np.ndarray:
        shared = spark.sparkContext.broadcast((of, now))

        def step(batches: Iterator[pa.RecordBatch]):
            of, now = shared.value
            for b in batches:
                rank = b.column("code").to_numpy() >> ITEM_BITS
                row, near, n = entries(b)
                slot = of[near >> 1] + k * (near & 1)
                slot[near >> 1 == rank[row]] = 2 * k
                old = of[rank]
                new = moves(now, old, row, slot, n)
                gone = new != old
                yield pa.RecordBatch.from_arrays([pa.array(rank[gone]), pa.array(new[gone].astype(np.int64))], ["rank", "class"])

        some = head.where(f"code >= {FREQUENT << ITEM_BITS} AND code < {HEAD << ITEM_BITS} AND (code >> {ITEM_BITS}) % 2 = {half}")
        new = of.copy()
        for r in some.mapInArrow(step, "rank bigint, class bigint").collect():  # at most the head
            new[r.rank] = r["class"]
        return new

    now = counts(groups)
    while True:
        start = likelihood(now)
        for half in (0, 1):
            tried = round_of(groups, now, half)
            after = counts(tried)
            if likelihood(after) > likelihood(now):
                groups, now = tried, after
        if likelihood(now) - start < LEAST_GAIN * max(now.sum(), 1):
            return groups, now


def settle_rest(table: DataFrame, groups: np.ndarray, now: np.ndarray) -> tuple[DataFrame, np.ndarray]:
    """Classes (code, class) of all words outside the head, written, and the final counts of neighbouring classes.

    Each word moves from its ending's class to the best one for its own neighbours. The
    counts are exact for the final classes: pairs with the head from a word's own row, pairs
    outside it joined by code.
    """
    spark, k = table.sparkSession, len(now)
    shared = spark.sparkContext.broadcast((groups, now))

    def choose(batches: Iterator[pa.RecordBatch]):
        of, now = shared.value
        sums = np.zeros(k * k, np.int64)
        for b in batches:
            code = b.column("code").to_numpy()
            row, near, n = entries(b)
            old = of[HEAD + 1 + (code & ((1 << ITEM_BITS) - 1)) - FREQUENT]
            new = moves(now, old, row, of[near >> 1] + k * (near & 1), n)
            known = near >> 1 <= HEAD
            add_pairs(sums, new[row[known]], near[known], n[known], of, k)
            yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(new.astype(np.int32)), pa.nulls(len(code), pa.int64())], ["code", "class", "n"])
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(-1 - at), pa.nulls(len(at), pa.int32()), pa.array(sums[at])], ["code", "class", "n"])

    found = written(table.where(f"code >= {TOP}").mapInArrow(choose, "code bigint, class int, n bigint"), "classes")
    classes = found.where("class IS NOT NULL").select("code", "class")
    with_head = cells(found.where("class IS NULL").select((-1 - F.col("code")).alias("cell"), "n"), k, k)

    def words(b: pa.RecordBatch, sums: np.ndarray) -> None:
        of, _ = shared.value
        row, near, n = entries(b)
        own = of[b.column("code").to_numpy() >> ITEM_BITS]
        keep = counted(near) & (near >> 1 <= HEAD)
        add_pairs(sums, own[row[keep]], near[keep], n[keep], of, k)

    inside = cells(summed(table.where(f"code < {TOP}"), k * k, words), k, k)

    def far_pairs(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            row, near, n = entries(b)
            far = (near & 1 == 0) & (near >> 1 > HEAD)
            yield pa.RecordBatch.from_arrays([pa.array(b.column("code").to_numpy()[row[far]]), pa.array(slices(b.column("others"), "<i8")[1]), pa.array(n[far])], ["code", "other", "n"])

    pairs = table.where(f"code >= {TOP} AND length(others) > 0").mapInArrow(far_pairs, "code bigint, other bigint, n bigint")
    left = pairs.join(classes.withColumnRenamed("class", "left"), "code").select("left", "other", "n")
    both = left.join(classes.select(F.col("code").alias("other"), F.col("class").alias("right")), "other")
    outside = cells(both.select((F.col("left") * k + F.col("right")).cast("long").alias("cell"), "n"), k, k)
    classes.written_path = found.written_path
    return classes, (inside + with_head + outside).astype(float)


def ending_sums(table: DataFrame) -> DataFrame:
    """(name, near, n): what words outside the head tell of pairs, summed by their endings."""
    low = (1 << ITEM_BITS) - 1

    def step(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            row, near, n = entries(b)
            keep = counted(near)
            name = HEAD + 1 + (b.column("code").to_numpy() & low) - FREQUENT
            pair, at = np.unique(name[row[keep]] * (2 * NEARS) + near[keep], return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(np.bincount(at, n[keep], len(pair)).astype(np.int64))], ["pair", "n"])

    pairs = table.where(f"code >= {TOP}").mapInArrow(step, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))
    return pairs.select(F.expr(f"pair div {2 * NEARS}").alias("name"), F.expr(f"pair % {2 * NEARS}").alias("near"), "n")


def cluster(table: DataFrame, n_classes: int) -> tuple[np.ndarray, np.ndarray, DataFrame, np.ndarray]:
    """Classes of items and of neighbour names, of the words outside the head, and the counts of neighbouring classes."""
    seeds = exchange(item_pairs(table), n_classes)
    low = (1 << ITEM_BITS) - 1
    groups = np.concatenate([np.zeros(HEAD, np.int64), [n_classes - 1], seeds[FREQUENT : FREQUENT + ENDINGS]])
    groups[:FREQUENT] = seeds[:FREQUENT]
    for r in table.where(f"code < {HEAD << ITEM_BITS}").select("code").collect():
        groups[r.code >> ITEM_BITS] = seeds[r.code & low]
    endings = written(ending_sums(table), "endings", compression="zstd")
    groups, now = settle_head(table, endings, groups, n_classes)
    discard(endings)
    classes, counts = settle_rest(table, groups, now)
    return seeds, groups, classes, counts


def class_tables(table: np.ndarray) -> np.ndarray:
    """log10 class transitions: Witten-Bell, interpolated with class frequencies."""
    whole = (table.sum(0) + 0.5) / (table.sum() + 0.5 * len(table))
    rows, kinds = table.sum(1, keepdims=True), (table > 0).sum(1, keepdims=True)
    return np.log10((table + np.maximum(kinds, 1) * whole) / (rows + np.maximum(kinds, 1)))


def partly_scored(texts: DataFrame, shared) -> DataFrame:
    """Scores of what is known in the task, and each text's other words with their places, for the join.

    ``holes`` has the classes (16 bits each, -1 for another word) of the other words and of
    the words beside them; ``rare`` tells the places of a word among the -1.
    """
    kind = texts.schema["caption_id"].dataType.simpleString()

    def step(batches: Iterator[pa.RecordBatch]):
        model: Model = shared.value
        last = len(model.total) - 1
        at = TaskContext.get().partitionId() << 33
        words: dict[bytes, int] = {}  # word -> place in the two lists
        group: list[int] = []
        log: list[float] = []
        fresh = lambda: ({k: [] for k in plain}, {k: [] for k in ("word", "guess", "spots")}, [0], [0])

        def table():
            struct = pa.StructArray.from_arrays([
                pa.array(rare["word"], pa.binary()), pa.array(rare["guess"], pa.int32()), pa.ListArray.from_arrays(pa.array(spot_ends, pa.int32()), pa.array(rare["spots"], pa.int32())),
            ], ["word", "guess", "spots"])
            held = [pa.array(out[k], arrow.field(k).type) for k in plain]
            return pa.RecordBatch.from_arrays([*held, pa.ListArray.from_arrays(pa.array(rare_ends, pa.int32()), struct)], [*plain, "rare"])

        out, rare, rare_ends, spot_ends = fresh()
        for b in batches:
            for key, train, raw in zip(*[b.column(c).to_pylist() for c in ("caption_id", "train", "raw")], strict=True):
                tokens = blank_words(raw)
                if len(words) > FLUSH:
                    words, group, log = {}, [], []
                codes = []
                for w in tokens:
                    k = words.get(w)
                    if k is None:
                        k = words[w] = len(group)
                        i, v = model.head.get(w) or (-1 - int(model.unseen[item_of(w)]), 0.0)  # below 0: another word, and its guess
                        group.append(i)
                        log.append(v)
                    codes.append(k)
                logs = sum([log[k] for k in codes])
                chain = np.array([last, *[group[k] for k in codes], last], np.int16)
                known = chain >= 0
                both = known[:-1] & known[1:]
                moves = model.move[chain[:-1][both], chain[1:][both]].sum() - model.total[chain[1:][known[1:]]].sum()
                beside = ~known
                beside[1:] |= ~known[:-1]
                beside[:-1] |= ~known[1:]
                spots: dict[int, list[int]] = {}
                for n, i in enumerate(np.flatnonzero(~known).tolist()):
                    spots.setdefault(codes[i - 1], []).append(n)
                if spots:
                    names = {codes[i - 1]: tokens[i - 1] for i in np.flatnonzero(~known).tolist()}
                    for k, x in spots.items():
                        rare["word"].append(names[k])
                        rare["guess"].append(-1 - group[k])
                        rare["spots"] += x
                        spot_ends.append(len(rare["spots"]))
                rare_ends.append(len(rare["word"]))
                row = (key, train, at, len(tokens) + 1, int(known.sum()) - 2, float(logs + model.end), float(moves), np.maximum(chain[beside], -1).tobytes())
                for k, v in zip(plain, row, strict=True):
                    out[k].append(v)
                at += 1
                if len(rare_ends) > 500:
                    yield table()
                    out, rare, rare_ends, spot_ends = fresh()
        yield table()

    plain = ["caption_id", "train", "row_no", "n_tokens", "held", "logs", "moves", "holes"]
    schema = (f"caption_id {kind}, train boolean, row_no bigint, n_tokens bigint, held bigint, logs double, moves double, holes binary, "
              "rare array<struct<word:binary,guess:int,spots:array<int>>>")
    arrow = to_arrow_schema(T._parse_datatype_string(schema))
    return texts.select("caption_id", "train", "raw").mapInArrow(step, schema)


def filled(rows: DataFrame, shared) -> DataFrame:
    """Adds the class moves of ``holes``, whose classes are in ``found``, to ``moves``."""
    kept = [c for c in rows.columns if c not in ("holes", "found")]

    def step(batches: Iterator[pa.RecordBatch]):
        model: Model = shared.value
        for b in batches:
            at, chain = slices(b.column("holes"), "<i2")
            found, moves = b.column("found"), b.column("moves").to_numpy()
            chain = chain.copy()
            gap = np.flatnonzero(chain < 0)
            first = np.searchsorted(gap, at[:-1])  # of each row, its first gap
            size = found.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            flat = found.flatten()
            spots = flat.field("spots")
            times = spots.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            base = np.repeat(first, size) if len(size) else first
            chain[gap[np.repeat(base, times) + spots.flatten().to_numpy()]] = np.repeat(flat.field("class").to_numpy(), times)
            open_ = np.zeros(len(chain), bool)
            open_[gap] = True
            row = np.repeat(np.arange(b.num_rows), np.diff(at))
            pair = (open_[:-1] | open_[1:]) & (row[:-1] == row[1:])
            more = np.bincount(row[:-1][pair], model.move[chain[:-1][pair], chain[1:][pair]], b.num_rows) - np.bincount(row[gap], model.total[chain[gap]], b.num_rows)
            columns = [pa.array(moves + more) if c == "moves" else b.column(c) for c in kept]
            yield pa.RecordBatch.from_arrays(columns, kept)

    return rows.mapInArrow(step, T.StructType([rows.schema[c] for c in kept]))


def score_captions(captions: DataFrame, n_classes: int = 64, head_words_most: int = HEAD) -> DataFrame:
    """Log probabilities of caption texts under a class bigram model and a unigram model.

    captions(caption_id, text, train): rows with ``train`` teach. Tokens are blank-free
    words, A-Z lower-cased, and one end for each text. Word counts and class bigrams are
    taken over all training texts. All words of the training texts are put into
    ``n_classes`` classes by exchange clustering: the ``FREQUENT`` most frequent words, with
    the endings of all others, one after another; then the rest of the ``head_words_most`` (at most ``HEAD``) most frequent by
    themselves, in rounds on Spark that move half of them at a time; then every other
    word by its own neighbours. A token's probability is that of its class after the
    class before, times that of the word in its class, (c + 0.5) / (N_class + 0.5 * (V_class + 1)).
    Words unseen in training are in the first class of their ending.

    Returns per caption row: caption_id, train, n_tokens, n_known (tokens seen in
    training), train_tokens, base_score (unigram log10, add 0.5), score (class model
    log10), perplexity (of the class model).

    Null or empty text: one token, the end. Null ``train`` counts as false. No training row: zero
    counts, and both models give the reserve of unseen words. Repeated rows give repeated
    rows, an empty table an empty one; other columns are ignored. Counts and classes of all
    but the ``HEAD`` most frequent words are joined to the texts' rare words by word.
    """
    texts = captions.select("caption_id", F.coalesce("train", F.lit(False)).alias("train"), raw_text("text").alias("raw"))
    training = texts.where("train")
    counts = written(word_counts(training), "words")
    sums = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.count("*").alias("words")).first()
    ends = training.count()
    tokens, kinds = sums.tokens + ends, sums.words + (ends > 0)
    head = head_words(counts, head_words_most)
    codes = {w: head_code(k, w) for k, (w, _) in enumerate(head)}
    table = written(contexts(neighbours(training, codes)), "contexts", compression="zstd")
    seeds, groups, classes, pairs = cluster(table, n_classes)
    discard(table)
    known = {w: (int(groups[codes[w] >> ITEM_BITS]), math.log10(n + 0.5)) for w, n in head}
    rest = counts.where(F.col("n") < head[-1][1]) if head else counts  # the head has all words of its counts
    others = written(rest.join(classes, "code").select("word", "n", "class"), "classed")
    discard(counts, classes)
    sizes = np.zeros((n_classes, 2))
    for r in others.groupBy("class").agg(F.sum("n").alias("n"), F.count("*").alias("words")).collect():
        sizes[r["class"]] = r.n, r.words
    for w, n in head:
        sizes[known[w][0]] += n, 1
    sizes[-1] = ends, ends > 0
    total = np.log10(sizes[:, 0] + 0.5 * (sizes[:, 1] + 1))
    shared = captions.sparkSession.sparkContext.broadcast(Model(known, seeds, class_tables(pairs), total, math.log10(ends + 0.5)))
    part = written(partly_scored(texts, shared), "scores", compression="zstd")
    rare = part.select("row_no", F.explode("rare").alias("r")).select("row_no", "r.word", "r.guess", "r.spots", F.size("r.spots").alias("times"))
    joined = rare.join(others, "word", "left").groupBy("row_no").agg(
        F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("rare_logs"), F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("rare_known"),
        F.collect_list(F.struct(F.coalesce("class", "guess").alias("class"), "spots")).alias("found"),
    )
    joined = written(joined, "rare", compression="zstd")
    discard(others)
    logs = F.col("logs") + F.coalesce("rare_logs", F.lit(0.0))
    return filled(part.drop("rare").join(joined, "row_no", "left"), shared).select(
        "caption_id", "train", "n_tokens", (F.col("held") + F.coalesce("rare_known", F.lit(0)) + F.lit(int(ends > 0))).alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"),
        (logs - F.col("n_tokens") * math.log10(tokens + 0.5 * (kinds + 1))).alias("base_score"), (logs + F.col("moves")).alias("score"),
        F.pow(F.lit(10.0), -(logs + F.col("moves")) / F.col("n_tokens")).alias("perplexity"),
    )
