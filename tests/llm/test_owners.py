"""Exact copies against a dictionary of whole texts."""

import hashlib
import random
import re

from spanframe import fixtures
from spanframe.llm.owners import Trie, own_texts, strings


def brute(rows):
    groups = {}
    for k, (i, t) in enumerate(rows):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i is None, i, k))
    out = []
    for text, members in groups.items():
        best = min(members, key=lambda m: (m[0], m[1], "" if m[2] is None else m[2], m[3]))
        out += [(m[2], best[2], len(members), m[3] == best[3], hashlib.sha256(text.encode()).hexdigest()) for m in members]
    return sorted(out, key=repr)


def rows_of(df):
    return sorted(((r.cue_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in df.collect()), key=repr)


def some_rows():
    rng = random.Random(5)
    base = ["".join(rng.choice("ab cé\n") for _ in range(rng.randint(0, 40))) for _ in range(60)]
    rows = [(f"c{k:04d}", rng.choice(base) + rng.choice(["", " ", "\n\t"])) for k in range(600)]
    rows += [(None, base[0]), (None, base[0]), ("c0001", base[1]), ("c0001", base[1]), ("n1", None), ("n2", ""), ("n3", " \n"), ("long", "xy z" * 300_000), ("long2", "xyz" * 300_000)]
    return rows + [(f"p{k}", "x" * k) for k in range(50)] + [("nb", "a b"), ("sep", "a\x1cb"), ("plain", "ab")]


def test_owners_equal_brute_force(spark):
    rows = some_rows()
    cues = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "cue_id string, text string, node int, row_no string").repartition(5).sortWithinPartitions("cue_id")
    seen = [(r.cue_id, r.text) for r in cues.collect()]
    assert rows_of(own_texts(cues)) == brute(seen)


def test_subtrees_given_up_change_nothing(spark):
    rows = some_rows()
    cues = spark.createDataFrame(rows, "cue_id string, text string").repartition(3)
    whole, spilled = rows_of(own_texts(cues)), rows_of(own_texts(cues, store=3000))
    assert whole == spilled


def test_trie_prunes_and_keeps_the_rest():
    trie, texts = Trie(), [b"", b"a", b"ab", b"abc", b"abd", b"b" * 50, b"b" * 49 + b"c"]
    for t in texts:
        trie.place(t).payload = [t]
    assert sorted(p for p, _ in strings(trie.root, b"")) == sorted(texts)
    gone = [p for p, _ in trie.prune(True)]
    assert gone and sorted(gone + [p for p, _ in strings(trie.root, b"")]) == sorted(texts)
    assert trie.place(gone[0]).gone is not None and trie.place(b"zz").gone is None
    one = Trie()
    one.place(b"abc").payload = [1]
    assert one.prune(True) == [] and one.root.size > 0


def test_empty_and_library_records(spark):
    empty = spark.createDataFrame([], "cue_id long, text string")
    assert own_texts(empty).count() == 0
    cues = fixtures.cues(spark, "/root/testdata/sf0.001")
    assert rows_of(own_texts(cues)) == brute([(r.cue_id, r.text) for r in cues.collect()])
