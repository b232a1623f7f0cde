"""Licence scans: matching statistics on a generalised suffix automaton of licence words."""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame

from .common import arrow_map, plain_words, raw_text

# Phrases that name a licence by themselves.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
_NOTICE = ("this program is free software you can redistribute it and or modify it under the terms of the gnu {} public license as published by "
           "the free software foundation either version {} of the license or at your option any later version")
_COMMONS = "this work is licensed under {} creative commons attribution {} international license"
# The short notices of common licences, from their published texts; variants are templates of their own.
NOTICES = [
    *[(label, _NOTICE.format(name, version)) for label, name, versions in (("gpl", "general", "23"), ("lgpl", "lesser general", "3"), ("agpl", "affero general", "3")) for version in versions],
    ("lgpl", _NOTICE.format("lesser general", "2 1").replace("program", "library")),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    *[("cc-by" + "".join("-" + short for short, _ in terms), _COMMONS.format(article, " ".join([*[long for _, long in terms], "4 0"])))
      for terms in ([], [("sa", "sharealike")], [("nd", "noderivatives")], [("nc", "noncommercial")], [("nc", "noncommercial"), ("sa", "sharealike")], [("nc", "noncommercial"), ("nd", "noderivatives")])
      for article in ("a", "the")],
]
ENOUGH = 20  # words of a template that count as found, however long it is


def licence_texts() -> list[tuple[str, str]]:
    """(licence, words) of the whole published texts beside this module, one file to a version."""
    folder = Path(__file__).with_name("licences")
    return [(f.name.split(".")[0], b" ".join(plain_words(f.read_bytes())).decode()) for f in sorted(folder.glob("*.txt"))]


class Automaton:
    """Suffix automaton of several word sequences.

    For each state: its longest string, its suffix link, the transitions, and the places
    ``(notice, end)`` where its strings end.
    """

    def __init__(self, sequences: list[list[bytes]]):
        self.size, self.link, self.step, self.places = [0], [-1], [{}], [[]]
        for n, words in enumerate(sequences):
            last = 0
            for i, w in enumerate(words):
                last = self.extend(last, w)
                self.places[last].append((n, i + 1))
        for s in sorted(range(1, len(self.size)), key=lambda s: -self.size[s]):
            self.places[self.link[s]] += self.places[s]
        self.places = [sorted(set(p)) for p in self.places]

    def state(self, size: int, link: int, step: dict) -> int:
        self.size.append(size)
        self.link.append(link)
        self.step.append(step)
        self.places.append([])
        return len(self.size) - 1

    def split(self, p: int, q: int, w: bytes) -> int:
        """A state of its own for the strings of ``q`` that end in ``p`` and ``w``."""
        if self.size[q] == self.size[p] + 1:
            return q
        copy = self.state(self.size[p] + 1, self.link[q], dict(self.step[q]))
        self.link[q] = copy
        while p >= 0 and self.step[p].get(w) == q:
            self.step[p][w] = copy
            p = self.link[p]
        return copy

    def extend(self, last: int, w: bytes) -> int:
        if w in self.step[last]:
            return self.split(last, self.step[last][w], w)
        new, p = self.state(self.size[last] + 1, 0, {}), last
        while p >= 0 and w not in self.step[p]:
            self.step[p][w] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self.split(p, self.step[p][w], w)
        return new


class Scanner:
    """Streams words through the automaton; phrases end at their own states."""

    def __init__(self, phrases: dict[str, str], notices: list[tuple[str, str]], least: int, gap: int):
        self.phrases, self.notices, self.least, self.gap = list(phrases.items()), notices, least, gap
        seqs = [p.encode().split() for p, _ in self.phrases] + [t.encode().split() for _, t in notices]
        self.lengths = [len(s) for s in seqs]
        a = self.automaton = Automaton(seqs)
        self.vocab = {w for s in seqs for w in s}
        own = [[] for _ in a.size]  # phrases that a state's strings may end with
        for n in range(len(self.phrases)):
            s = 0
            for w in seqs[n]:
                s = a.step[s][w]
            own[s].append((n, self.lengths[n]))
        for s in sorted(range(1, len(a.size)), key=lambda s: a.size[s]):
            own[s] = own[s] + own[a.link[s]]
        self.ends = own

    def statistics(self, words: list[bytes]) -> Iterator[tuple[int, int, int]]:
        """(position, state, length of the longest match that ends there), lengths of 2 or more."""
        a, vocab, state, length = self.automaton, self.vocab, 0, 0
        step, link, size = a.step, a.link, a.size
        before = -2
        for i, w in enumerate(words):
            if w not in vocab:
                continue
            if i != before + 1:
                state = length = 0
            before = i
            while state and w not in step[state]:
                state = link[state]
                length = size[state]
            state = step[state][w]
            length += 1
            if length > 1:
                yield i, state, length

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], list[tuple[int, int, int, int]]]:
        """Phrase places (phrase, first word), and chains of matches (template, first word, end, words covered)."""
        places, matches, last = [], [], None
        for i, state, length in self.statistics(words):
            places += [(n, i - m + 1) for n, m in self.ends[state] if length >= m]
            if last and not (last[0] == i - 1 and length == last[2] + 1) and last[2] >= self.least:
                matches.append(last)
            last = (i, state, length)
        if last and last[2] >= self.least:
            matches.append(last)
        return places, self.chain(matches)

    def chain(self, matches: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
        """Chains long matches that follow each other in text and template; all chains that nothing follows any more."""
        done: list[tuple[int, int, int, int]] = []
        open_: dict[int, list[tuple[int, int, int, int]]] = {}
        for i, state, length in matches:
            for n, end in self.automaton.places[state]:
                if n < len(self.phrases):
                    continue
                start, first, covered = end - length, i - length + 1, length
                lively = []
                for c in open_.get(n, ()):
                    (lively if first - c[0] <= self.gap else done).append(c if first - c[0] <= self.gap else (n, c[2], c[0], c[3]))
                for stop, upto, begin, had in lively:
                    if stop <= i and upto < end:
                        fresh = length - max(0, upto - start, stop - (i - length + 1))
                        if fresh > 0 and had + fresh > covered:
                            first, covered = begin, had + fresh
                open_[n] = [c for c in lively if not (c[1] >= end and c[3] <= covered)] + [(i + 1, end, first, covered)]
        return done + [(n, c[2], c[0], c[3]) for n, chains in open_.items() for c in chains]

    def spans(self, chains: list[tuple[int, int, int, int]], cover: float) -> list[tuple[int, int, int, float]]:
        """The chains that count, most words first; of those that share half a span the first stays."""
        share = lambda c: c[3] / self.lengths[c[0]]
        kept: list[tuple[int, int, int, float]] = []
        for c in sorted((c for c in chains if c[3] >= ENOUGH or share(c) >= cover), key=lambda c: (-c[3], -share(c), c[0], c[1])):
            if all(2 * (min(c[2], k[2]) - max(c[1], k[1])) < c[2] - c[1] for k in kept):
                kept.append((c[0], c[1], c[2], share(c)))
        return sorted(kept, key=lambda k: (k[1], k[0]))


def scan_rights(sources: DataFrame, phrases: dict[str, str] | None = None, notices: list[tuple[str, str]] | None = None,
                least: int = 4, gap: int = 60, cover: float = 0.8) -> DataFrame:
    """Licence statements in the rights texts of sources.

    sources(source_id, text). ``phrases`` maps a phrase to its licence; ``notices`` are
    (licence, template text), by default short notices and the whole published texts. A
    template counts where a chain of matches of at least ``least`` words, with at most ``gap``
    words between two, covers ``ENOUGH`` words or the share ``cover`` of it; so a later
    clause alone is found too. Of templates that match one place the one with
    the most words there stays, then the one covered most, then the first.

    The library's sources have no rights text of their own: the text of their captions or
    of a file beside them goes in under the source's id.

    Returns per source row: source_id, n_words, places (array of phrase, start_word),
    notices (array of label, start_word, end_word, cover), labels (sorted, distinct: of
    phrases and notices), phrase_labels (of phrases only), cover (largest share of a
    notice, 1.0 with any phrase, 0.0 without a match).

    Null or empty text: no words, nothing found. Repeated rows give repeated rows, an
    empty table an empty one; other columns are ignored. Each text is streamed once,
    whole, and only its matches are held.
    """
    texts = sources.select("source_id", raw_text("text").alias("raw"))
    kind = sources.schema["source_id"].dataType.simpleString()
    scanner = Scanner(phrases or PHRASES, NOTICES + licence_texts() if notices is None else notices, least, gap)
    schema = (f"source_id {kind}, n_words bigint, places array<struct<phrase:string,start_word:bigint>>, "
              "notices array<struct<label:string,start_word:bigint,end_word:bigint,cover:double>>, labels array<string>, phrase_labels array<string>, cover double")

    def step(batches: Iterator[dict[str, list]]):
        names = scanner.phrases
        for b in batches:
            out = {"source_id": b["source_id"], **{k: [] for k in ("n_words", "places", "notices", "labels", "phrase_labels", "cover")}}
            for raw in b["raw"]:
                words = plain_words(raw)
                places, chains = scanner.scan(words)
                by = {names[n][1] for n, _ in places}
                held = [(scanner.notices[n - len(names)][0], *c) for n, *c in scanner.spans(chains, cover)]
                out["n_words"].append(len(words))
                out["places"].append([{"phrase": names[n][0], "start_word": at} for n, at in places])
                out["notices"].append([dict(zip(("label", "start_word", "end_word", "cover"), c, strict=True)) for c in held])
                out["labels"].append(sorted(by | {c[0] for c in held}))
                out["phrase_labels"].append(sorted(by))
                out["cover"].append(1.0 if places else max([c[3] / scanner.lengths[c[0]] for c in chains], default=0.0))
            yield out

    return arrow_map(texts, schema, step)

