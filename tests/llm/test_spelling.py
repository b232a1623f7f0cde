"""Spelling variants against all pairs."""

import random
from collections import Counter

from spanframe import fixtures
from spanframe.llm import spelling
from spanframe.llm.spelling import count_words, group_spellings, neighbours


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute(counts, least=3, shortest=5):
    words = {w: n for w, n in counts.items() if n >= least and len(w) >= shortest}
    found = {w: [v for v in words if v != w and near(w, v)] for w in words}
    form = {}
    for w, vs in found.items():
        best = min(vs, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None
    out = []
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, words[w], len(found[w]), words.get(form[w])))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted(((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()), key=repr)


def some_counts(seed=4, size=900):
    rng = random.Random(seed)
    words = Counter()
    for _ in range(size):
        w = "".join(rng.choice("abcé" if rng.random() < 0.8 else "àÿxyzß") for _ in range(rng.randint(4, 9)))
        words[w] = rng.randint(1, 40)
    for w in list(words)[:200]:
        k = rng.randrange(len(w))
        words[w[:k] + w[k + 1 :]] = rng.randint(3, 9)
        words[w[:k] + "q" + w[k:]] = rng.randint(3, 200)
    long = "ab" * 30_000
    words.update({long: 8, long + "c": 4, long[:-1]: 20, "aabbc": 5, "abcab": 5, "αβγδε": 9, "αβγδ": 50, "αβγδζ": 20, "🙂aaaa": 3, "🙂aaab": 6})
    return words


def test_groups_equal_all_pairs(spark, monkeypatch):
    counts = some_counts()
    rows = [(w, n // 2, "x") for w, n in counts.items()] + [(w, n - n // 2, "y") for w, n in counts.items()] + [(None, 5, "z"), ("abcde", None, "n")]
    words = spark.createDataFrame(rows, "text string, n long, word string")
    assert rows_of(group_spellings(words)) == brute(counts)
    monkeypatch.setattr(spelling, "TILE", 60)  # many tiles in a block
    monkeypatch.setattr(spelling, "HEAVY", 0)
    assert rows_of(group_spellings(words)) == brute(counts)


def test_chain_of_forms_and_single_rows(spark):
    counts = {"a" * 5 + "b" * k: 3 * 2**k for k in range(20)}
    words = spark.createDataFrame([(w, n) for w, n in counts.items()], "text string, n long")
    assert rows_of(group_spellings(words)) == brute(counts)
    rows = [("hello",)] * 3 + [("hallo",)] * 6 + [("tiny",)] * 9
    assert rows_of(group_spellings(spark.createDataFrame(rows, "text string"))) == brute(Counter(r[0] for r in rows))


def test_every_near_block_is_reached():
    rng = random.Random(1)
    for _ in range(300):
        at = [rng.randint(0, 3) for _ in range(4)]
        name = ".".join(map(str, at))
        for i in range(4):
            up = [*at]
            up[i] += 1
            assert name in neighbours(".".join(map(str, up)))
            for j in range(4):
                if j != i and up[j]:
                    moved = [*up]
                    moved[j] -= 1
                    other = ".".join(map(str, moved))
                    assert (other in neighbours(name)) or (name in neighbours(other))


def test_counts_and_library_records(spark):
    cues = spark.createDataFrame([("a", "Été, ÉTÉ été x×y ab1cd İb"), ("b", None), ("c", ""), (None, "Abab abab")], "cue_id string, text string")
    got = {r.word: r.n for r in count_words(cues).collect()}
    assert got == {"Été": 1, "ÉtÉ": 1, "été": 1, "x×y": 1, "ab": 1, "cd": 1, "b": 1, "abab": 2}
    halved = count_words(cues, lambda key, found: [(w[:2], n) for w, n in found.items()])
    assert {r.word: r.n for r in halved.collect()}["ab"] == 3
    assert group_spellings(spark.createDataFrame([], "text string, n long")).count() == 0
    words = count_words(fixtures.cues(spark, "/root/testdata/sf0.001")).withColumnRenamed("word", "text")
    assert rows_of(group_spellings(words)) == brute({r.text: r.n for r in words.collect()})
