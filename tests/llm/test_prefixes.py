"""The prefix tree against one built from Python tuples."""

import hashlib
import random
from collections import defaultdict

from spanframe import fixtures
from spanframe.llm.prefixes import cue_tree


def brute(rows, sources=()):
    paths = defaultdict(list)
    for s in sources:
        if s is not None:
            paths[s] = []
    framed = lambda r: (f"{len((r[2] or '').encode())}:{r[2] or ''}{r[3] or ''}").encode()
    for r in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0, hashlib.sha256(framed(r)).digest())):
        paths[r[0]].append((r[2] or "", r[3] or ""))
    members = defaultdict(list)
    for s, p in paths.items():
        for d in range(len(p) + 1):
            members[tuple(p[:d])].append(s)
    children = defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, m in members.items():
        words = len(p[-1][1].encode().split()) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(m) - 1) * words
    return sorted(
        ((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p],
          hashlib.sha256(",".join(str(s) for s in sorted(m) if len(paths[s]) == len(p)).encode()).hexdigest()) for p, m in members.items()), key=repr)


def rows_of(df):
    names = ["source_id", "depth", "parent_source_id", "n_sources", "n_children", "n_leaves", "saved_words", "ends_sha256"]
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


SCHEMA = "source_id long, ord long, speaker string, text string, node string, pos int"


def test_tree_equals_brute_force(spark):
    rng = random.Random(2)
    texts = ["", "a", "a b", "hello\tthere you", None, "é ü", "x " * 2000]
    rows = []
    for s in range(120):
        at = [(rng.choice(["user", "bot", None]), rng.choice(texts)) if rng.random() < 0.2 else ("user", "a b") for _ in range(rng.choice([0, 1, 2, 7, 8, 9, 15, 16, 17, 24, 33]))]
        rows += [(s, k, *a, "n", 1) for k, a in enumerate(at)]
    rows += [(7, None, "user", "first of all", "n", 1), (None, 1, "user", "nobody", "n", 1), (500, 3, "x", "tie", "n", 1), (500, 3, "x", "other tie", "n", 1), (500, 3, "x", "tie", "n", 1)]
    sources = [*range(120), 900, 901, None]
    cues = spark.createDataFrame(rows, SCHEMA).repartition(4)
    named = spark.createDataFrame([(s, 1) for s in sources], "source_id long, key int")
    plain = [r[:4] for r in rows]
    assert rows_of(cue_tree(cues, named)) == brute(plain, sources)
    assert rows_of(cue_tree(cues)) == brute(plain)


def test_empty_turnless_and_library_records(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert cue_tree(empty).count() == 0
    only = spark.createDataFrame([(3,), (1,), (3,)], "source_id long")
    assert rows_of(cue_tree(empty, only)) == brute([], [3, 1])
    cues = fixtures.cues(spark, "/root/testdata/sf0.001")
    assert rows_of(cue_tree(cues)) == brute([(r.source_id, r.ord, r.speaker, r.text) for r in cues.collect()])
