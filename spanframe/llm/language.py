"""Language ID: interpolated Kneser-Ney character models in sorted hash arrays."""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, blank_words, raw_text

START, END = "\x02", "\x03"
LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*")
MULT, FULL = 0x9E3779B97F4A7C15, (1 << 64) - 1
CACHE = 400_000  # words whose scores a task keeps at a time
EVIDENCE = 25  # characters whose evidence the score counts at most
NONE = "und"


def letter_words(words: list[bytes]) -> Iterator[list[str]]:
    """Lower-cased letter runs of each blank-free word."""
    for w in b" ".join(words).decode("utf-8", "replace").lower().split(" "):
        yield [w] if w.isalpha() else LETTERS.findall(w)


def hashes(words: list[str], order: int) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """The n-grams that end at each character of the bracketed words.

    Returns word numbers, offsets in the word, and per order the distinct hashes of the
    last n characters with each character's place among them (any where the word has fewer).
    """
    text = "".join(START + w + END for w in words)
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32).astype(np.uint64) + np.uint64(1)
    sizes = np.array([len(w) + 2 for w in words])
    owner = np.repeat(np.arange(len(words)), sizes)
    offset = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    power, h = MULT, codes
    grams = [np.unique(h, return_inverse=True)]
    for n in range(2, order + 1):
        g = np.zeros(len(codes), np.uint64)
        g[n - 1 :] = h[n - 1 :] + codes[: len(codes) - n + 1] * np.uint64(power)
        g[offset < n - 1] = 0
        grams.append(np.unique(g, return_inverse=True))
        h, power = g, power * MULT & FULL
    return owner, offset, grams


class Model:
    """One language: per order the sorted hashes, log10 probabilities and back-off weights."""

    def __init__(self, counts: dict[str, int], order: int):
        by: list[dict[str, int]] = [defaultdict(int) for _ in range(order + 1)]
        for gram, n in counts.items():
            by[len(gram)][gram] = n
        # below the highest order a gram counts the characters seen before it, except at the word start
        kept: list[dict[str, int]] = [{} for _ in range(order + 1)]
        kept[order] = dict(by[order])
        for n in range(order - 1, 0, -1):
            seen: dict[str, int] = defaultdict(int)
            for gram in by[n + 1]:
                seen[gram[1:]] += 1
            kept[n] = {g: (c if g[0] == START else seen.get(g, 0)) for g, c in by[n].items() if g != START and (g[0] == START or g in seen)}
        self.letters = len(kept[1]) + 1
        self.floor = math.log10(1 / (self.letters + 1))
        prob: dict[str, float] = {}
        self.order, self.arrays = order, []
        lower = 1 / (self.letters + 1)
        for n in range(1, order + 1):
            grams = kept[n]
            ones, twos = sum(1 for c in grams.values() if c == 1), sum(1 for c in grams.values() if c == 2)
            cut = ones / (ones + 2 * twos) if ones and twos else 0.5
            total: dict[str, int] = defaultdict(int)
            kinds: dict[str, int] = defaultdict(int)
            for g, c in grams.items():
                total[g[:-1]] += c
                kinds[g[:-1]] += 1
            self.back = {h: cut * kinds[h] / total[h] for h in total}
            if n > 1:
                self.arrays[-1][2][:] = self.weights(self.arrays[-1][3], self.back)
            else:
                self.root = math.log10(self.back.get("", 1.0))
            now = {g: (c - cut) / total[g[:-1]] + self.back[g[:-1]] * (prob.get(g[1:], lower) if n > 1 else lower) for g, c in grams.items()}
            names = list(now)
            if n == 1:
                names.append(START)  # never predicted, but a context
            keys = self.keys(names)
            at = np.argsort(keys)
            names = [names[i] for i in at]
            self.arrays.append([keys[at], np.log10(np.array([now.get(g, 1.0) for g in names])).astype(np.float32), np.zeros(len(names), np.float32), names])
            prob = now
        self.arrays = [a[:3] for a in self.arrays]
        del self.back

    @staticmethod
    def keys(grams: list[str]) -> np.ndarray:
        out = np.zeros(len(grams), np.uint64)
        for i, g in enumerate(grams):
            h, power = 0, 1
            for c in reversed(g):
                h = (h + (ord(c) + 1) * power) & FULL
                power = power * MULT & FULL
            out[i] = h
        return out

    @staticmethod
    def weights(names: list[str], back: dict[str, float]) -> np.ndarray:
        return np.log10(np.array([back.get(g, 1.0) for g in names])).astype(np.float32)

    def score(self, owner: np.ndarray, offset: np.ndarray, grams: list[tuple[np.ndarray, np.ndarray]], n_words: int) -> np.ndarray:
        """log10 probability of each word, its end included; each distinct n-gram is looked up once."""
        log, context = None, None
        for n, (keys, prob, weight) in enumerate(self.arrays, 1):
            some, place = grams[n - 1]
            at = np.minimum(np.searchsorted(keys, some), len(keys) - 1)
            hit = keys[at] == some
            own = np.where(hit, prob[at], np.float32(np.nan))[place]
            if n == 1:
                log = np.where(np.isnan(own), np.float32(self.root + self.floor), own)
            else:
                back = np.zeros(len(log), np.float32)
                back[1:] = context[:-1]
                full = offset >= n - 1
                log = np.where(full & ~np.isnan(own), own, log + np.where(full, back, np.float32(0)))
            context = np.where(hit, weight[at], np.float32(0))[place]
        inner = offset > 0
        return np.bincount(owner[inner], weights=log[inner], minlength=n_words)


def sample_rows(cues: DataFrame, rows_per_language: int) -> DataFrame:
    """About ``rows_per_language`` labelled rows per language, by a hash of the row's key.

    The rate of a language is the bound over its row count, so no language is ordered or
    gathered and the choice does not depend on the partitioning.
    """
    known = cues.where("train AND lang IS NOT NULL AND text IS NOT NULL").select("cue_id", "text", "lang")
    rate = known.groupBy("lang").agg((F.lit(float(rows_per_language)) / F.count("*")).alias("rate"))
    draw = (F.xxhash64(F.col("cue_id").cast("string"), F.lit("language")).bitwiseAND(0xFFFFFFFF)) / F.lit(float(1 << 32))
    return known.join(F.broadcast(rate), "lang").where(draw < F.col("rate")).withColumn("held", F.xxhash64(F.col("cue_id").cast("string"), F.lit("held")).bitwiseAND(3) == 0)


def gram_counts(sample: DataFrame, order: int) -> DataFrame:
    """(lang, gram, n) of the bracketed words of the sample's fitting part."""

    def words(batches: Iterator[dict[str, list]]):
        for b in batches:
            found: dict[tuple[str, str], int] = defaultdict(int)
            for lang, raw in zip(b["lang"], b["raw"], strict=True):
                for parts in letter_words(blank_words(raw)):
                    for part in parts:
                        found[lang, part] += 1
            yield {"lang": [k[0] for k in found], "word": [k[1] for k in found], "n": list(found.values())}

    def grams(batches: Iterator[dict[str, list]]):
        for b in batches:
            found: dict[tuple[str, str], int] = defaultdict(int)
            for lang, word, n in zip(b["lang"], b["word"], b["n"], strict=True):
                text = START + word + END
                for m in range(1, order + 1):
                    for i in range(len(text) - m + 1):
                        found[lang, text[i : i + m]] += n
            yield {"lang": [k[0] for k in found], "gram": [k[1] for k in found], "n": list(found.values())}

    fit = sample.where("NOT held").select("lang", raw_text("text").alias("raw"))
    once = arrow_map(fit, "lang string, word string, n bigint", words).groupBy("lang", "word").agg(F.sum("n").alias("n"))
    return arrow_map(once, "lang string, gram string, n bigint", grams).groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Judge:
    """Scores whole texts under all models; words are scored once per task while cached."""

    def __init__(self, models: dict[str, Model], order: int):
        self.langs, self.models, self.order = sorted(models), models, order
        self.cache: dict[bytes, int] = {}
        self.table, self.length = np.zeros((0, len(self.langs))), np.zeros(0, np.int64)

    def learn(self, words: list[bytes]) -> None:
        parts, owner = [], []
        for i, some in enumerate(letter_words(words)):
            parts += some
            owner += [i] * len(some)
        logs = np.zeros((len(words), len(self.langs)))
        chars = np.zeros(len(words), np.int64)
        for cut in range(0, len(parts), 50_000):
            some, own = parts[cut : cut + 50_000], np.array(owner[cut : cut + 50_000])
            who, offset, grams = hashes(some, self.order)
            for k, lang in enumerate(self.langs):
                logs[:, k] += np.bincount(own, weights=self.models[lang].score(who, offset, grams, len(some)), minlength=len(words))
            chars += np.bincount(own, weights=[len(p) + 1 for p in some], minlength=len(words)).astype(np.int64)
        self.table, self.length = np.concatenate([self.table, logs]), np.concatenate([self.length, chars])

    def totals(self, raws: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """Per text and language the log10 probability, and the scored characters."""
        if len(self.cache) > CACHE:
            self.cache.clear()
            self.table, self.length = self.table[:0], self.length[:0]
        cache, codes, bounds, fresh = self.cache, [], [0], []
        for raw in raws:
            for w in blank_words(raw):
                k = cache.get(w)
                if k is None:
                    k = cache[w] = len(cache)
                    fresh.append(w)
                codes.append(k)
            bounds.append(len(codes))
        if fresh:
            self.learn(fresh)
        ids, cut = np.array(codes, np.int64), np.array(bounds)
        logs, chars = np.zeros((len(raws), len(self.langs))), np.zeros(len(raws), np.int64)
        full = np.flatnonzero(np.diff(cut))
        if len(full):
            logs[full] = np.add.reduceat(self.table[ids], cut[full], axis=0)
            chars[full] = np.add.reduceat(self.length[ids], cut[full])
        return logs, chars


def judged(cues: DataFrame, shared, order: int) -> DataFrame:
    """cue_id, lang_pred, score, entropy (log10 per character), n_chars."""
    kind = cues.schema["cue_id"].dataType.simpleString()

    def step(batches: Iterator[dict[str, list]]):
        judge = Judge(shared.value, order)
        for b in batches:
            out = {k: [] for k in ("cue_id", "lang_pred", "score", "entropy", "n_chars")}
            for cut in range(0, len(b["raw"]), 512):
                logs, chars = judge.totals(b["raw"][cut : cut + 512])
                for row, n in zip(logs, chars.tolist(), strict=True):
                    if not n or not judge.langs:
                        out["lang_pred"].append(NONE)
                        out["score"].append(0.0)
                        out["entropy"].append(None)
                    else:
                        mean = row / n
                        best = int(mean.argmax())
                        odds = 10.0 ** np.maximum((mean - mean[best]) * min(n, EVIDENCE), -300)
                        out["lang_pred"].append(judge.langs[best])
                        out["score"].append(float(1 / odds.sum()))
                        out["entropy"].append(float(-mean[best]))
                    out["n_chars"].append(n)
            out["cue_id"] = b["cue_id"]
            yield out

    return arrow_map(cues.select("cue_id", raw_text("text").alias("raw")), f"cue_id {kind}, lang_pred string, score double, entropy double, n_chars bigint", step)


def identify_language(cues: DataFrame, order: int = 4, rows_per_language: int = 400, strictness: float = 8.0) -> DataFrame:
    """The language of each transcript cue, learned from the labelled cues.

    cues(cue_id, text, lang, train): ``lang`` is a label or null, ``train`` says whether a
    row may teach. One interpolated Kneser-Ney character model per language is fitted on a
    sample of about ``rows_per_language`` labelled rows (3/4 of it; the rest calibrates).
    Only ``text`` enters a prediction.

    Returns per cue row: cue_id, lang_pred, score (0 to 1: share of the best language,
    counting the evidence of at most 25 characters), entropy (log10 per character, null
    without letters), n_chars (letters and word ends scored), rejected. A cue is rejected
    if it has no letter, or if its entropy exceeds its language's calibrated level by
    ``strictness`` standard deviations, which shrink with its length.

    Null, empty or letterless text: ``und``, score 0, rejected. Ties go to the first
    language in order. No labelled row, or an empty table: all ``und``. Repeated rows give
    repeated rows; other columns are ignored.
    """
    spark = cues.sparkSession
    sample = sample_rows(cues, rows_per_language)
    counts: dict[str, dict[str, int]] = defaultdict(dict)
    for r in gram_counts(sample, order).toLocalIterator():
        counts[r.lang][r.gram] = r.n
    shared = spark.sparkContext.broadcast({lang: Model(c, order) for lang, c in counts.items()})
    counts.clear()
    held = judged(sample.where("held").select("cue_id", "text"), shared, order).where("n_chars >= 20")
    levels = held.groupBy("lang_pred").agg(
        F.avg("entropy").alias("level"), F.coalesce(F.stddev("entropy"), F.lit(0.0)).alias("spread"),
        F.coalesce(F.stddev(F.col("entropy") * F.sqrt("n_chars")) / 2, F.lit(0.0)).alias("noise"),
    )
    limit = F.col("level") + strictness * (F.greatest("spread", F.lit(0.01)) + F.greatest("noise", F.lit(0.3)) / F.sqrt("n_chars"))
    seen = judged(cues.select("cue_id", "text"), shared, order)
    return seen.join(F.broadcast(levels), "lang_pred", "left").select(
        "cue_id", "lang_pred", "score", "entropy", "n_chars",
        ((F.col("lang_pred") == NONE) | F.coalesce(F.col("entropy") > limit, F.lit(False))).alias("rejected"),
    )
