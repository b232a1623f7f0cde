"""Spelling variants among the words of cues: blocked Gram matrices of letter counts.

The squared distance of two words' letter counts is at most two when they are one edit
apart.  Words are blocked by how many letters of each of ``GROUPS`` letter groups they
hold, so that their length is the sum; near words lie in blocks that differ by one letter
moved between groups, or by one letter more.  Blocks are cut into tiles, and every task
multiplies the count matrix of its tile by those of the neighbouring tiles.  What stays
within distance two is compared letter by letter.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, discard, joinable, raw_text, written

RUN = re.compile("[A-Za-zÀ-ÿ]+")
HELD = 8 << 20  # letters of distinct words that a counting task holds
GROUPS = 8  # letter groups that name a block
SLOTS = 90  # letter counts of a word: a to z, and 64 for all other letters
TILE = 8_192  # letters of a tile
WIDE = 4_096  # words of neighbouring tiles multiplied at once
HEAVY = 200_000  # blocks of several tiles that are sent to the words; more meet them by key
KEPT = 100_000  # words whose partners a task sums before it hands them on


def count_words(cues: DataFrame, change: Callable[[object, Counter], Iterable[tuple[str, int]]] | None = None) -> DataFrame:
    """word, n of the letter runs ``[A-Za-z\\u00C0-\\u00FF]+`` of all cues (cue_id, text), A-Z lower-cased.

    ``change`` may turn a cue's counted words into others.  Null texts have no words.
    Tasks sum what they hold before a shuffle, so a frequent word is one row per flush.
    """

    def count(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        counts, held = {}, 0
        for batch in batches:
            for key, raw in zip(batch["cue_id"], batch["raw"], strict=True):
                found = Counter(RUN.findall(raw.lower().decode())) if raw else {}
                for word, n in change(key, found) if change else found.items():
                    have = counts.get(word)
                    if have is None:
                        counts[word], held = n, held + len(word) + 20
                    else:
                        counts[word] = have + n
                if held > HELD:
                    yield {"word": list(counts), "n": list(counts.values())}
                    counts, held = {}, 0
        if counts:
            yield {"word": list(counts), "n": list(counts.values())}

    return arrow_map(cues.select("cue_id", raw_text("text").alias("raw")), "word string, n long", count).groupBy("word").agg(F.sum("n").alias("n"))


def slots(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points and letter slots of words of one length, a row each."""
    codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).reshape(len(words), -1)
    return codes, np.where((codes >= 97) & (codes <= 122), codes - 97, 26 + codes % 64)


def letter_counts(at: np.ndarray) -> np.ndarray:
    """Count matrix of letter slots; exact in float32 while a word's squared length is."""
    rows = np.arange(len(at))[:, None] * SLOTS + at
    return np.bincount(rows.ravel(), minlength=len(at) * SLOTS).reshape(len(at), SLOTS).astype(np.float32 if at.shape[1] < 4_000 else np.float64)


def near_pairs(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], own: bool) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``a`` and ``b`` (codes, counts) that are one edit apart; b's words are as long as a's or one letter longer."""
    (codes_a, counts_a), (codes_b, counts_b) = a, b
    gram = counts_a @ counts_b.T
    gram *= -2
    gram += np.einsum("ij,ij->i", counts_a, counts_a)[:, None]
    gram += np.einsum("ij,ij->i", counts_b, counts_b)[None, :]
    i, j = np.nonzero(gram <= 2)
    if own:
        i, j = i[i < j], j[i < j]
    long, keep = codes_a.shape[1], np.zeros(len(i), dtype=bool)
    step = max(1, 4_000_000 // long)
    for k in range(0, len(i), step):
        x, y = codes_a[i[k : k + step]], codes_b[j[k : k + step]]
        if codes_b.shape[1] == long:
            keep[k : k + step] = (x != y).sum(axis=1) == 1
        else:
            front = np.minimum.accumulate(x == y[:, :-1], axis=1).sum(axis=1)
            back = np.minimum.accumulate((x == y[:, 1:])[:, ::-1], axis=1).sum(axis=1)
            keep[k : k + step] = front + back >= long
    return i[keep], j[keep]


def block_key(counts: Iterable[int]) -> str:
    return ".".join(map(str, counts))


def neighbours(key: str) -> list[str]:
    """Blocks that a block's tiles are sent to: itself, those of its length that follow by name, those one letter shorter."""
    at = [int(k) for k in key.split(".")]
    out = [key]
    for i in range(len(at)):
        if at[i]:
            less = [*at[:i], at[i] - 1, *at[i + 1 :]]
            out.append(block_key(less))
            for j in range(len(at)):
                if j != i and (moved := block_key([*less[:j], less[j] + 1, *less[j + 1 :]])) > key:
                    out.append(moved)
    return out


def letter_groups(vocabulary: DataFrame) -> list[int]:
    """The group of each letter slot: groups hold about equally many letters of the vocabulary (90 sums)."""

    def count(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        sums = np.zeros(SLOTS, dtype=np.int64)
        for batch in batches:
            if batch["word"]:
                sums += np.bincount(slots(["".join(batch["word"])])[1].ravel(), minlength=SLOTS)
        yield {"slot": list(range(SLOTS)), "n": sums.tolist()}

    sums = {r.slot: r.n for r in arrow_map(vocabulary.select("word"), "slot int, n long", count).groupBy("slot").agg(F.sum("n").alias("n")).collect()}
    loads, groups = [0] * GROUPS, [0] * SLOTS
    for slot in sorted(range(SLOTS), key=lambda s: (-sums.get(s, 0), s)):
        groups[slot] = min(range(GROUPS), key=lambda g: (loads[g], g))
        loads[groups[slot]] += sums.get(slot, 0)
    return groups


def tiled(vocabulary: DataFrame) -> DataFrame:
    """Tiles (block, tile, words, ns) of about ``TILE`` letters; a word longer than that is one by itself."""
    groups = np.array(letter_groups(vocabulary))

    def name(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        for batch in batches:
            keys = [block_key(np.bincount(groups[slots([w])[1].ravel()], minlength=GROUPS)) if len(w) > 64 else short(w) for w in batch["word"]]
            yield {"block": keys, "word": batch["word"], "n": batch["n"]}

    table = {chr(c): int(g) for c in [*range(97, 123), *range(0xC0, 0x100)] for g in [groups[c - 97 if c < 128 else 26 + c % 64]]}

    def short(word: str) -> str:
        counts = [0] * GROUPS
        for c in word:
            g = table.get(c)
            counts[int(groups[26 + ord(c) % 64]) if g is None else g] += 1
        return block_key(counts)

    blocked = arrow_map(vocabulary.select("word", "n"), "block string, word string, n long", name)
    blocked = written(blocked, "spelling-words")
    heavy = blocked.groupBy("block").agg(F.ceil(F.sum(F.length("word")) / TILE).cast("int").alias("tiles")).where("tiles > 1")
    heavy = written(heavy, "spelling-heavy")
    dealt = blocked.join(joinable(heavy, HEAVY), "block", "left").select(
        "block", F.coalesce(F.pmod(F.xxhash64("word"), F.col("tiles")), F.lit(0)).cast("int").alias("tile"), "word", "n",
    )
    rows = F.collect_list(F.struct("word", "n"))
    out = written(dealt.groupBy("block", "tile").agg(rows.alias("rows")).select("block", "tile", "rows.word", "rows.n").toDF("block", "tile", "words", "ns"), "spelling-tiles")
    discard(blocked, heavy)
    return out


def partners(tiles: DataFrame) -> DataFrame:
    """word, n_near, best (its near word of largest n) of every word that has a near one."""

    def send(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        for batch in batches:
            rows = [(b, t, to) for b, t in zip(batch["block"], batch["tile"], strict=True) for to in neighbours(b)]
            yield dict(zip(["block", "tile", "to_block"], map(list, zip(*rows, strict=True)), strict=True)) if rows else {"block": [], "tile": [], "to_block": []}

    def compare(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        found: dict[str, list] = {}

        def meet(word: str, other: str, n: int) -> None:
            have = found.get(word)
            if have is None:
                found[word] = [1, n, other]
                return
            have[0] += 1
            if n > have[1] or (n == have[1] and other < have[2]):
                have[1], have[2] = n, other

        def both(own: tuple, words: list[str], ns: list[int], same: bool) -> None:
            codes, at = slots(words)
            i, j = near_pairs(own[2:], (codes, letter_counts(at)), same)
            for x, y in zip(i.tolist(), j.tolist(), strict=True):
                meet(own[0][x], words[y], ns[y])
                meet(words[y], own[0][x], own[1][x])

        def rows() -> dict[str, list]:
            out = {"word": list(found), "near": [v[0] for v in found.values()], "best_n": [v[1] for v in found.values()], "best": [v[2] for v in found.values()]}
            found.clear()
            return out

        at, own, waiting = None, None, {}
        for batch in batches:
            for block, tile, kind, words, ns in zip(batch["to_block"], batch["to_tile"], batch["kind"], batch["words"], batch["ns"], strict=True):
                if (block, tile) != at:
                    for w, m in waiting.values():
                        both(own, w, m, False)
                    at, waiting = (block, tile), {}
                if kind == 0:
                    codes, places = slots(words)
                    own = (words, ns, codes, letter_counts(places))
                    both(own, words, ns, True)
                    continue
                have = waiting.setdefault(len(words[0]), ([], []))
                have[0].extend(words)
                have[1].extend(ns)
                if len(have[0]) >= WIDE or len(have[0]) * len(words[0]) >= 32 * TILE:
                    both(own, *waiting.pop(len(words[0])), False)
            if len(found) > KEPT:
                yield rows()
        for w, m in waiting.values():
            both(own, w, m, False)
        yield rows()

    names = tiles.select("block", "tile")
    sent = arrow_map(names, "block string, tile int, to_block string", send)
    sent = sent.join(names.toDF("to_block", "to_tile"), "to_block").where("block <> to_block OR tile < to_tile")
    copies = sent.join(tiles, ["block", "tile"]).select("to_block", "to_tile", F.lit(1).alias("kind"), "words", "ns")
    own = tiles.select(F.col("block").alias("to_block"), F.col("tile").alias("to_tile"), F.lit(0).alias("kind"), "words", "ns")
    met = own.unionByName(copies).repartition("to_block", "to_tile").sortWithinPartitions("to_block", "to_tile", "kind")
    found = arrow_map(met, "word string, near long, best_n long, best string", compare)
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("word")))
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), best.alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root of the words that have a form: forms followed to the last, by doubling.

    A form's count is at least twice the word's, so a path has at most 63 steps and six
    rounds reach its end.
    """
    last = written(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        on = last.toDF("root", "further")
        joined = last.join(on, "root", "left")
        more = written(joined.select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "spelling-roots")
        discard(last)
        last = more.select("word", "root")
        last.written_path = more.written_path
        if more.where("moved").isEmpty():
            return last


def group_spellings(words: DataFrame, least: int = 3, shortest: int = 5) -> DataFrame:
    """Spelling variants among words: near words, the form of each word and its root.

    ``words`` are the library's words (text), one row per occurrence, or with a column n
    counted rows; other columns are not read.  Distinct texts of at least ``shortest`` code
    points and ``least`` occurrences take part, compared as they are.  Two are near if they
    differ by exactly one code point inserted, deleted or replaced.  One row per such word:
    word, form (its near word of largest n, ties to the first in code-point order, if that n
    is at least twice its own, else null), root (forms followed to the last; the word itself
    without form), n, n_near, form_n.

    Null texts are no words, a null n counts nothing, repeated rows add up, very long words are compared whole.
    An empty table gives an empty table.
    """
    n = F.sum("n") if "n" in words.columns else F.count("*")
    vocabulary = words.where("text IS NOT NULL").groupBy(F.col("text").alias("word")).agg(n.cast("long").alias("n")).where((F.col("n") >= least) & (F.length("word") >= shortest))
    vocabulary = written(vocabulary, "spelling-vocabulary")
    tiles = tiled(vocabulary)
    near = written(partners(tiles), "spelling-near")
    best_n = -F.col("best.less")
    told = vocabulary.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(best_n >= 2 * F.col("n"), F.col("best.word")).alias("form"), F.when(best_n >= 2 * F.col("n"), best_n).alias("form_n"),
    )
    told = written(told, "spelling-forms")
    ends = roots(told.where("form IS NOT NULL"))
    out = written(told.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"), "spelling")
    discard(vocabulary, tiles, near, told, ends)
    return out
