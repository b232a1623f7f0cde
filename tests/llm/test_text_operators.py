"""Each operator against a brute-force version on small records, with nulls, ties, repeats and empty tables."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from spanframe.llm.copies import find_near_copies
from spanframe.llm.language import identify_language
from spanframe.llm.leaks import find_leaks
from spanframe.llm.linededup import dedup_lines
from spanframe.llm.outliers import chi_quantile, consistency, screen_units, text_statistics
from spanframe.llm.rights import NOTICES, PHRASES, Scanner, scan_rights

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BLANK = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def prose(rng, n, words):
    out = []
    while len(out) < n:
        out += [rng.choice(words) for _ in range(rng.randint(3, 9))]
        out[-1] += rng.choice([".", ",", ".\n"])
    return " ".join(out[:n])


VOCAB = [a + b for a in "ka lo mi nu pre stra tion".split() for b in "ba de fi go hu ra st én".split()]


def test_leaks_equal_brute_force(spark):
    rng = random.Random(3)
    cases = [("c1", prose(rng, 40, VOCAB)), ("c2", prose(rng, 14, VOCAB)), ("c3", "Short CASE!"), ("c4", None), ("c5", "..."), (None, "kaba lode"), ("c1b", prose(rng, 25, VOCAB))]
    texts = [prose(rng, rng.randint(0, 200), VOCAB) for _ in range(60)]
    for k in range(0, 60, 3):
        words = (cases[k % 2][1]).split()
        at = rng.randint(0, 4)
        texts[k] += " " + " ".join(words[at : at + rng.randint(8, 14)]) + " tail short case"
    rows = [*enumerate(texts), (100, None), (101, ""), (102, "short\x00case"), (103, texts[0] * 40), (0, texts[0])]
    segments = spark.createDataFrame([(i, t, "x") for i, t in rows], "segment_id long, text string, n_words string")
    table = spark.createDataFrame(cases, "case_id string, text string")
    windows = defaultdict(set)
    for c, t in cases:
        w = WORD.findall(lower(t))
        if c and w:
            for k in range(max(1, len(w) - 9)):
                windows[tuple(w[k : k + 10])].add(c)

    def brute(t):
        w, hit, found = WORD.findall(lower(t)), set(), set()
        for m in {len(k) for k in windows}:
            for k in range(len(w) - m + 1):
                if tuple(w[k : k + m]) in windows:
                    found |= windows[tuple(w[k : k + m])]
                    hit |= set(range(k, k + m))
        return len(w), frozenset(hit), tuple(sorted(found))

    want = Counter((i, *brute(t)) for i, t in rows)
    got = find_leaks(segments, table).collect()
    flat = lambda r: (r.segment_id, r.n_words, frozenset(k for s in r.spans for k in range(s.start_word, s.end_word)), tuple(r.case_ids))
    assert Counter(map(flat, got)) == want
    blocks = find_leaks(segments.dropDuplicates(["segment_id"]), table, block_windows=12).collect()
    assert {flat(r) for r in blocks} == set(want)
    assert find_leaks(segments.limit(0), table).count() == 0
    assert all(not r.spans for r in find_leaks(segments, table.limit(0)).collect())


def test_rights_equal_brute_force(spark):
    rng = random.Random(5)
    parts = [*PHRASES, *[t for _, t in NOTICES], "the license", "by", "cc", "general public", "mit"]
    rows = [(i, " ".join(rng.choice([*parts, *VOCAB[:8]]).upper() if rng.random() < 0.2 else rng.choice([*parts, *VOCAB[:8]]) for _ in range(rng.randint(0, 30)))) for i in range(150)]
    rows += [(900, None), (901, ""), (902, "cc by cc by " * 500), (902, "cc by cc by " * 500), (903, "MIT-License"), (904, "mit\x00license")]
    found = scan_rights(spark.createDataFrame([(i, t, "z") for i, t in rows], "source_id long, text string, labels string")).collect()

    def brute(t):
        w = WORD.findall(lower(t))
        return len(w), tuple(sorted((k, p) for p in PHRASES for q in [p.split()] for k in range(len(w) - len(q) + 1) if w[k : k + len(q)] == q))

    got = Counter((r.source_id, r.n_words, tuple(sorted((p.start_word, p.phrase) for p in r.places))) for r in found)
    assert got == Counter((i, *brute(t)) for i, t in rows)
    assert all(set(r.phrase_labels) == {PHRASES[p.phrase] for p in r.places} and set(r.phrase_labels) <= set(r.labels) for r in found)
    whole = scan_rights(spark.createDataFrame([(k, "x y " + t + " z") for k, (_, t) in enumerate(NOTICES)], "source_id long, text string")).collect()
    assert all(NOTICES[r.source_id][0] in r.labels and max(n.cover for n in r.notices) == 1.0 for r in whole)
    # a notice with a gap inside is one chained span
    gap = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met".split()
    one = scan_rights(spark.createDataFrame([(1, " ".join(gap[:9] + ["kaba"] * 5 + gap[10:]))], "source_id long, text string")).first()
    assert [(n.label, n.start_word, n.end_word) for n in one.notices] == [("bsd", 0, len(gap) + 4)] and one.cover < 0.2
    assert scan_rights(spark.createDataFrame([], "source_id long, text string")).count() == 0


CLAUSES = [
    ("mit", "AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License"),
    ("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("cc-by-nc-sa", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("cc-by-nd", "This work is licensed under the Creative Commons Attribution-NoDerivatives 4.0 International License"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("apache", "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce"),
    ("bsd", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice"),
    (None, "The software is provided to our readers and the work is licensed to nobody at all, under the terms of this text"),
]


def test_clauses_and_variants_have_their_own_labels(spark):
    rows = [(k, f"Some words before. {t} And after.") for k, (_, t) in enumerate(CLAUSES)]
    got = {r.source_id: sorted({n.label for n in r.notices}) for r in scan_rights(spark.createDataFrame(rows, "source_id long, text string")).collect()}
    assert got == {k: [w] if w else [] for k, (w, _) in enumerate(CLAUSES)}


def test_chains_cover_what_brute_force_covers():
    """A chain's words are at least the longest run that text and template share; matching statistics are exact."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(8)]
    templates = [("a", " ".join(rng.choice(words) for _ in range(40))), ("b", " ".join(rng.choice(words) for _ in range(25)))]
    scanner = Scanner({"w0 w1": "p"}, templates, 2, 10)
    for _ in range(40):
        text = [rng.choice(words) for _ in range(30)]
        at = rng.randrange(20)
        text[5:15] = templates[0][1].split()[at : at + 10]
        best = {}
        for i, _, length in scanner.statistics([w.encode() for w in text]):
            best[i] = length
        whole = ["w0 w1".split(), *[t.split() for _, t in templates]]
        for i in range(len(text)):
            want = max((m for m in range(2, i + 2) if any(text[i - m + 1 : i + 1] == w[k : k + m] for w in whole for k in range(len(w) - m + 1))), default=0)
            assert best.get(i, 0) == want
        _, chains = scanner.scan([w.encode() for w in text])
        assert max(c[3] for c in chains if c[0] == 1) >= 10


def test_line_dedup_removes_repeated_chunks(spark):
    rng = random.Random(7)
    passage = "\n".join(prose(rng, 12, VOCAB).replace("\n", " ") for _ in range(12))
    long_line = " ".join(rng.choice(VOCAB) for _ in range(60))
    rows = [(i, prose(rng, 80, [w + str(i) for w in VOCAB])) for i in range(10)]
    rows += [(20, rows[1][1] + "\n" + passage + "\n" + rows[2][1] + "x"), (21, passage), (22, "a\n" + long_line + "\nb"), (23, "c\n\n" + long_line), (24, None), (25, ""), (26, "x\ny\n\nx\ny"), (27, "\n\n")]
    table = spark.createDataFrame([(i, t, 1) for i, t in rows], "source_id long, text string, n_left int")
    got = {r.source_id: r for r in dedup_lines(table).collect()}
    lines = {i: (t or "").split("\n") for i, t in rows}
    assert set(got) == set(lines)
    for i, r in got.items():
        left = r.text.split("\n") if r.n_removed < r.n_lines else []
        assert r.n_lines == len(lines[i]) and r.n_removed + len(left) == r.n_lines
        rest = iter(lines[i])
        assert all(any(x == y for y in rest) for x in left)  # in order, nothing added
    assert all(got[i].n_removed == 0 for i in range(10))
    assert got[22].text == "a\n" + long_line + "\nb" and got[23].text == "c\n"
    assert got[21].n_left < 8  # most of the passage went, all but its ends
    assert dedup_lines(table.limit(0)).count() == 0
    twice = dedup_lines(table.union(table)).collect()
    assert Counter((r.source_id, r.text) for r in twice) == Counter({(i, r.text): 2 for i, r in got.items()})
    kept = dedup_lines(table.withColumn("lang", F.lit("en")), carried=["lang"])
    assert kept.columns[-1] == "lang" and kept.where("lang = 'en'").count() == len(rows)


def test_line_dedup_leaves_nothing_of_copies(spark):
    rng = random.Random(8)
    line = lambda long: " ".join(rng.choice(VOCAB) for _ in range(rng.randint(50, 70) if long else rng.randint(1, 9)))
    texts = ["\n".join([line(rng.random() < 0.3) if rng.random() < 0.9 else " " for _ in range(rng.randint(1, 25))]) for _ in range(120)]
    texts += ["\n".join([line(True), "short", line(True)]), "alone", "first\n" + line(True), line(True) + "\nlast"]
    copies = [(1000 + k, t) for k, t in enumerate(texts)]
    rows = [*enumerate(texts), *copies, (3000, None), (3001, "")]
    got = {r.source_id: r for r in dedup_lines(spark.createDataFrame(rows, "source_id long, text string")).collect()}
    assert all(got[i].n_left == 0 for i, _ in copies)
    once = dedup_lines(spark.createDataFrame(list(enumerate(texts)), "source_id long, text string")).collect()
    assert {r.source_id: r.text for r in once} == {i: got[i].text for i in range(len(texts))}
    lines = lambda ts: {x for t in ts for x in t.split("\n") if BLANK.search(x)}
    assert lines(texts) == lines(r.text for r in once)  # every line stays somewhere


def test_leaks_in_many_blocks_equal_one(spark):
    rng = random.Random(9)
    cases = [(f"c{k}", prose(rng, rng.randint(3, 30), VOCAB)) for k in range(9)]
    texts = [prose(rng, 60, VOCAB) + " " + rng.choice(cases)[1] for _ in range(20)]
    rows = [(rng.choice([None, 1, 2]), t) for t in texts] + [(None, None), (1, "")]
    segments, table = spark.createDataFrame(rows, "segment_id long, text string"), spark.createDataFrame(cases, "case_id string, text string")
    seen = lambda df: sorted(repr(tuple(r)) for r in df.collect())
    assert seen(find_leaks(segments, table)) == seen(find_leaks(segments, table, block_windows=1)) == seen(find_leaks(segments, table, block_windows=40))


def test_unit_statistics_equal_brute_force(spark):
    rng = random.Random(11)
    texts = [prose(rng, rng.randint(0, 120), VOCAB[: rng.randint(1, 20)]) for _ in range(80)]
    texts += ["", None, " \t\n ", "a a a a a", "é # <|> $$ x\x0by\x1cz", "x\nx\n \nx", "a b c a b c", "one two three"]
    got = text_statistics(spark.createDataFrame(list(enumerate(texts)), "unit_id long, text string")).collect()
    for r in got:
        t = texts[r.unit_id] or ""
        w = BLANK.findall(t)
        seen, hit = Counter(zip(w, w[1:], w[2:])), set()
        for k in range(len(w) - 2):
            if seen[w[k], w[k + 1], w[k + 2]] > 1:
                hit |= {k, k + 1, k + 2}
        lines = [x for x in t.split("\n") if BLANK.search(x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_lines, r.n_dup_lines, r.n_repeat_words) == (
            len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines), len(lines) - len(set(lines)), len(hit))


def test_units_far_from_their_source_are_rejected(spark):
    rng = random.Random(13)
    rows = [(i, prose(rng, rng.randint(60, 200), VOCAB), "en" if i % 2 else None, f"s{i % 3}") for i in range(400)]
    bad = {5, 50, 300}
    rows = [(i, " ".join(w + "###$$" for w in t.split()) if i in bad else t, a, b) for i, t, a, b in rows]
    rows += [(900, prose(rng, 80, VOCAB), "xx", "alone"), (901, None, "en", None), (902, "few words", "en", "s1"), (903, "a b " * 60, "en", "s1")]
    table = spark.createDataFrame([(*r, "q") for r in rows], "unit_id long, text string, lang string, source_id string, kept string")
    got = {r.unit_id: r for r in screen_units(table).collect()}
    assert len(got) == len(rows)
    assert {i for i, r in got.items() if r.outlier and not r.failed} == bad
    assert got[900].kept and got[900].distance is None
    assert got[901].failed and got[902].failed and got[903].failed
    assert screen_units(table.limit(0)).count() == 0


def test_outliers_start_at_the_chi_square_quantile(spark):
    assert abs(chi_quantile(0.999, 5) - 20.515) < 1e-3 and abs(chi_quantile(0.75, 5) - 6.6257) < 1e-4
    assert consistency(1.0) == 1.0 and 1.3 < consistency(0.75) < 1.5
    rng = random.Random(17)
    rows = []
    for i in range(400):
        t = prose(rng, rng.randint(60, 200), VOCAB)
        for _ in range(max(1, len(t) // 18) if i < 20 else i < 40):
            at = rng.randrange(len(t))
            t = t[:at] + "#" + t[at:]
        rows.append((i, t, "en", "s"))
    got = {r.unit_id: r for r in screen_units(spark.createDataFrame(rows, "unit_id long, text string, lang string, source_id string")).collect()}
    assert all(got[i].outlier for i in range(20))  # 5% of symbols, where the others have none
    assert not any(got[i].outlier for i in range(20, 40))  # a single symbol is counting noise
    assert sum(r.outlier for i, r in got.items() if i >= 40) <= 4



def brute_groups(texts, n, percent):
    sets = {}
    for i, t in texts.items():
        w = BLANK.findall(lower(t))
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} or ({tuple(w)} if w else set())
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(texts)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    p, q = sorted((find(a), find(b)))
                    root[q] = p
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("n", [2, 5])
def test_near_copies_equal_brute_force(spark, n):
    rng = random.Random(17)
    texts = {i: prose(rng, rng.randint(20, 150), VOCAB) for i in range(40)}
    for i in range(40, 120):
        w = texts[rng.randrange(10)].split(" ")
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = rng.choice(VOCAB)
        texts[i] = " ".join(w)
    texts |= {200: "", 201: None, 202: " \n", 203: "One", 204: "one", 205: "one two", 206: "two one"}
    want = brute_groups(texts, n, 80)
    table = spark.createDataFrame([(i, t, 0) for i, t in texts.items()], "segment_id long, text string, component_id int")
    got = {r.segment_id: (r.n_shingles, r.component_id) for r in find_near_copies(table, words=n).collect()}
    assert got == want
    assert all(r.kept == (r.segment_id == r.component_id) for r in find_near_copies(table, words=n).collect())
    assert find_near_copies(table.limit(0), words=n).count() == 0


def test_one_large_group_of_copies_is_one_group(spark):
    rng = random.Random(19)
    base = prose(rng, 120, VOCAB).split(" ")
    rows = []
    for i in range(1500):
        w = list(base)
        w[rng.randrange(len(w))] = rng.choice(VOCAB)
        rows.append((i, " ".join(w if i % 2 else base)))
    got = find_near_copies(spark.createDataFrame(rows, "segment_id long, text string"), words=5).collect()
    assert {r.component_id for r in got} == {0} and sum(r.kept for r in got) == 1


def test_language_is_learned_and_rejects_the_unknown(spark):
    rng = random.Random(23)
    tongues = {"aa": [a + b for a in "ka lo mi".split() for b in "ba de fi go".split()], "bb": [a + b for a in "stra pre kri".split() for b in "zung heit lich".split()], "cc": ["éa", "çou", "ñil", "àber", "ôtu"]}
    rows = [(i, prose(rng, rng.randint(10, 80), tongues[x]), x, i % 4 != 2) for i in range(300) for x in [rng.choice("aa bb cc".split())]]
    rows += [(900, None, "aa", False), (901, "", None, True), (902, "12 34 !!", "bb", False), (903, "kaba", None, True), (904, "qwxz vxqj " * 60, None, False), (905, "КИТ ДОМ " * 40, None, False)]
    table = spark.createDataFrame([(*r, 0.5) for r in rows], "cue_id long, text string, lang string, train boolean, score double")
    got = {r.cue_id: r for r in identify_language(table).collect()}
    assert len(got) == len(rows)
    assert all(got[i].lang_pred == x and not got[i].rejected for i, _, x, _ in rows[:300])
    assert all(got[i].lang_pred == "und" and got[i].rejected and got[i].score == 0 for i in (900, 901, 902))
    assert got[903].lang_pred == "aa" and not got[903].rejected
    assert got[904].rejected and got[905].rejected
    assert all(0 <= r.score <= 1 for r in got.values())
    nothing = identify_language(table.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in nothing} == {"und"}
    assert identify_language(table.limit(0)).count() == 0
