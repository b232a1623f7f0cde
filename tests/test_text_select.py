"""Caption folds, literal search, selection and ledgers against plain models."""

import hashlib
import html
import html.entities
import random

import pytest
import re

from pyspark.sql import functions as F

from spanframe.functions import text as tf
from spanframe.operators import retrieve as rs
from spanframe.operators import signals as sg
from spanframe.operators import select as sel
from spanframe.operators import text as tx
from spanframe.operators import versions as vr


SPLITS = [
    ("", 5, []),
    ("a", 5, ["a"]),
    ("你好，世界！再见。", 5, ["你好，", "世界！", "再见。"]),
    ("你好，世界！再见。", 16, ["你好，世界！再见。"]),
    (" lead  and\ttail \n", 16, ["lead and tail"]),
    ("one, two, three.", 8, ["one,two,", "three."]),
    ("x" * 12, 5, ["xxxxx", "xxxxx", "xx"]),
    ("ab;cd", 2, ["ab", ";", "cd"]),
]


def test_split_caption_by_hand(spark):
    for text, limit, want in SPLITS:
        assert spark.createDataFrame([(text,)], "t string").select(tf.split_caption("t", limit).alias("c")).first().c == want, text


def test_split_caption_keeps_all_and_fills_chunks(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab ,。!x ") for _ in range(rng.randint(1, 160))) for _ in range(150)]
    visible = lambda s: "".join(s.split())
    for limit in (5, 16):
        for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", tf.split_caption("t", limit).alias("c")).collect():
            assert visible("".join(r.c)) == visible(r.t)  # nothing lost or added
            assert all(0 < len(visible(c)) <= limit for c in r.c)
            for one, two in zip(r.c, r.c[1:]):  # the next sentence would not have fitted
                first = re.match(r"[^。!,]*[。!,]?", two).group()
                whole = first[-1] in "。!,"  # else a piece of a sentence that is too long by itself
                assert not whole or len(visible(one + first)) > limit or one[-1] not in "。!,"


def test_group_words_breaks_on_size_time_and_punctuation(spark):
    def row(k, items):
        return [(k, i, t, s, d, 10_000_000) for i, (t, s, d) in enumerate(items)]

    rows = row("size", [("abcd", 0, 100_000), ("efgh", 100_000, 100_000), ("ij", 200_000, 100_000)])
    rows += row("time", [("a", 0, 100_000), ("b", 3_150_000, 100_000)]) + row("punct", [("a", 0, 500_000), ("b", 500_000, 400_000), ("。", 950_000, 40_000), ("c", 1_000_000, 50_000)])
    w = spark.createDataFrame(rows, "k string, ord long, text string, start_us long, dur_us long, audio_us long")
    got = {}
    for r in tx.group_words(w, ["k"], 8).orderBy("k", "ord").collect():
        got.setdefault(r.k, []).append((r.text, r.start_us, r.end_us))
    assert got["size"] == [("abcdefgh", 0, 200_000), ("ij", 200_000, 700_000)]
    assert got["time"] == [("a", 0, 500_000), ("b", 3_150_000, 3_650_000)]
    assert got["punct"] == [("ab", 0, 900_000), ("。c", 950_000, 1_450_000)]


def test_literal_pairs_equal_nested_contains(spark):
    rng = random.Random(4)
    words = ["ab", "cd", "e", "fgh", "ij"]
    texts = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 25)))) for i in range(60)]
    needles = [(j, t) for j, t in enumerate(["ab cd", "e", "b c", "cd e fgh", "ab cd e fgh ij ab", "h ij a", "zz", "d e fgh ij ab cd e", "fgh"])]
    got = sorted(map(tuple, tx.literal_pairs(spark.createDataFrame(needles, "needle_id long, text string"), spark.createDataFrame(texts, "text_id long, text string")).collect()))
    assert got == sorted((i, j) for i, t in texts for j, n in needles if n in t)


def test_terms_and_guard(spark):
    r = spark.createDataFrame([("Not Before 你好吗 x1",)], "t string").select(tf.terms("t").alias("x"), tf.text_units("t").alias("u")).first()
    assert sorted(r.x) == sorted(["not", "before", "x1", "你好", "好吗"]) and r.u == 6
    q = spark.createDataFrame([("He believes it", ["intends to go", "walks"], ["Ann"])], "change string, events array<string>, aliases array<string>")
    assert tx.guard_query(q).first().query == "Ann walks"


def test_dedup_and_diversity_model(spark):
    rng = random.Random(9)
    rows = []
    for w in ("w1", "w2", "w3"):
        for i in range(60):
            s = rng.randint(0, 400)
            rows.append((w, f"h{i}", i, rng.choice("ab"), s, s + rng.randint(1, 90), [rng.choice(["t1", "t2", "t3"])], rng.choice([[], ["p"], ["q"]]), rng.randint(0, 9), rng.randint(40, 99), rng.randint(0, 45)))
    df = spark.createDataFrame(rows, "work_id string, highlight_id string, ord long, source_id string, start_us long, end_us long, types array<string>, characters array<string>, score long, confidence long, redundancy long")
    out = {(r.work_id, r.highlight_id): r for r in sel.ledger(df, 40, final_size=8).collect()}
    for w in ("w1", "w2", "w3"):
        ranked = sorted((r for r in rows if r[0] == w), key=lambda r: (-r[8], r[2]))
        kept, picked = [], []
        for r in ranked[:40]:
            hit = next((k for k in kept if k[3] == r[3] and max(0, min(k[5], r[5]) - max(k[4], r[4])) * 100 >= 65 * max(1, min(k[5] - k[4], r[5] - r[4]))), None)
            assert out[w, r[1]].absorbed_by == (hit[1] if hit else None)
            if hit is None:
                kept.append(r)
        for r in kept:
            n = len(picked) + 1
            if n > 8:
                why = "NOT_REACHED"
            elif r[9] < 62:
                why = "LOW_CONFIDENCE"
            elif r[10] > 35:
                why = "REDUNDANT"
            elif n > 4 and (sum(p[6][0] == r[6][0] for p in picked) + 1) * 100 > 45 * n:
                why = "TYPE_SHARE"
            elif r[7] and n > 4 and (sum(p[7][:1] == r[7] for p in picked) + 1) * 100 > 65 * n:
                why = "CHARACTER_SHARE"
            else:
                why = ""
                picked.append(r)
            assert (out[w, r[1]].rejection, out[w, r[1]].selected) == (why, why == "")
        assert all(out[w, r[1]].rejection == "POOL_BUDGET_EXHAUSTED" for r in ranked[40:])


def test_pool_is_round_robin_with_bounded_exploration(spark):
    rows = [("w", b, f"u{b}{i}", float(9 - i), i == 0, i + 1) for b in ("1", "2", "3") for i in range(4)] + [("w", "1", "u20", 0.5, False, 5)]
    r = spark.createDataFrame(rows, "work_id string, beat_id string, unit_id string, score double, direct boolean, rank long")
    got = rs.pick_pool(r, 6, 0.5).orderBy("pick").collect()
    assert len(got) == 6 and len({g.unit_id for g in got}) == 6
    assert sum(g.direct for g in got) == 3 and [g.direct for g in got[:3]] == [True] * 3
    small = rs.pick_pool(r, 6, 0.5, budget=25, size_fn=lambda p: p.unit_id.str.len() * 0 + 10).collect()
    assert len(small) == 2


def test_pool_with_a_budget_looks_behind_its_front(spark):
    rng = random.Random(3)
    rows = []
    for w in ("w1", "w2"):
        for b in range(4):
            for i in range(60):
                rows.append((w, f"{w}b{b}", f"u{rng.randint(0, 150):03d}-{max(1, 400 - 7 * i)}", rng.random() < 0.3, i + 1))
    size = lambda u: int(u.split("-")[1])
    for limit, budget in ((6, 900), (5, 2500), (8, 3)):
        want = []
        for w in ("w1", "w2"):
            by = {b: [r for r in rows if r[0] == w and r[1] == b] for b in {r[1] for r in rows if r[0] == w}}
            queue, taken, room, free = sorted(by, key=lambda b: hashlib.sha256(b.encode()).hexdigest()), [], budget, limit // 2
            while queue and len(taken) < limit:
                b = queue.pop(0)
                r = next((r for r in by[b] if r[2] not in taken and (r[3] or free > 0) and size(r[2]) <= room), None)
                if r is not None:
                    queue.append(b)
                    taken.append(r[2])
                    room -= size(r[2])
                    free -= not r[3]
                    want.append((w, b, r[2], len(taken), r[3]))
        df = spark.createDataFrame(rows, "work_id string, beat_id string, unit_id string, direct boolean, rank long")
        got = rs.pick_pool(df, limit, 0.5, budget=budget, size_fn=lambda p: p.unit_id.str.split("-").str[1].astype(int)).collect()
        assert sorted((r.work_id, r.beat_id, r.unit_id, r.pick, r.direct) for r in got) == sorted(want)


@pytest.mark.parametrize("k", [1, 5, 40])
def test_top_ranks_equal_the_whole_ranking(spark, k):
    rng = random.Random(k)
    words = [f"w{i}" for i in range(60)]
    held = {f"u{i:03d}": {w for j, w in enumerate(words) if rng.random() < 0.9 / (1 + j / 2)} for i in range(200)}
    asks = {"b1": set(rng.sample(words, 12)), "b2": set(words[:3]), "b3": {"w59", "w0"}, "b4": {"absent"}, "b5": set(words[40:])}
    units = spark.createDataFrame([(u, f"s{i % 2}", i * 10, i * 10 + 9) for i, u in enumerate(held)], "unit_id string, source_id string, start_us long, end_us long")
    terms = spark.createDataFrame([(u, t) for u, ts in held.items() for t in ts], "unit_id string, term string").join(units.select("unit_id", "source_id"), "unit_id")
    sources = spark.createDataFrame([(b, s) for b in asks for s in (["s0"] if b == "b3" else ["s0", "s1"])], "beat_id string, source_id string")
    query = spark.createDataFrame([(b, t) for b, ts in asks.items() for t in ts], "beat_id string, term string").join(sources, "beat_id")
    direct = spark.createDataFrame([("b1", "u003"), ("b2", "u150"), ("b4", "u007"), ("b3", "u001")], "beat_id string, unit_id string")
    reveals = spark.createDataFrame([(u, "e") for u in list(held)[::9]], "unit_id string, event_id string")
    allowed = spark.createDataFrame([("b1", "e"), ("b4", "e")], "beat_id string, event_id string")
    freq = rs.doc_freq(terms, units)
    whole = rs.rank(rs.exclusions(rs.score(query, terms, freq, match=["source_id"]), direct, units, sources, reveals, allowed))
    seen = lambda df: sorted((r.beat_id, r["rank"], r.unit_id, round(r.score, 6), r.direct) for r in df.where(F.col("rank") <= k).collect())
    top = rs.top_ranked(query, terms, freq, direct, units, sources, reveals, allowed, k, match=["source_id"])
    assert seen(top) == seen(whole)
    assert top.where("direct").count() == whole.where("direct").count()


def test_even_sample_positions(spark):
    df = spark.range(1, 23).select(F.lit("k").alias("k"), F.col("id"))
    for k in (1, 2, 5, 22, 40):
        got = [r.id - 1 for r in rs.sample_evenly(df, k, ["k"], ["id"], F.floor(F.col("id") / 4)).orderBy("id").collect()]
        n = 22
        assert got == (list(range(n)) if n <= k else [0] if k == 1 else sorted({i * (n - 1) // (k - 1) for i in range(k)}))


def test_budget_fold_model(spark):
    rng = random.Random(11)
    rows = [(b, f"{b}{i}", i, rng.choice([1, 2, 3, 7, 30])) for b in "xyz" for i in range(40)]
    got = {(r.budget_key, r.seq): r.accepted for r in vr.budget_fold(spark.createDataFrame(rows, "budget_key string, request_id string, seq long, amount long"), spark.createDataFrame([("x", 50), ("y", 9), ("z", 1000)], "budget_key string, limit long")).collect()}
    for b, limit in (("x", 50), ("y", 9), ("z", 1000)):
        used = 0
        for _, _, i, a in [r for r in rows if r[0] == b]:
            ok = used + a <= limit
            used += a if ok else 0
            assert got[b, i] == ok


@pytest.mark.parametrize("block", [4, 64])
def test_hot_budgets_are_settled_in_blocks(spark, block):
    rng = random.Random(block)
    limits = {"hot": 3_000, "wide": 2**61, "none": 0, "debt": -5, "one": 40, "slow": 5_000}
    rows = [("hot", f"h{i}", i, rng.choice([0, 1, 2, 9, 17, 64, 300, 900, None, -3])) for i in range(900)]
    rows += [("wide", f"w{i}", i, rng.choice([1, 2**40, 2**58, 2**60, 2**61, 2**62])) for i in range(90)]
    rows += [(k, f"{k}{i}", i, rng.choice([0, 1, 30])) for k in ("none", "debt", "one") for i in range(9)]
    rows += [("slow", f"s{i}", i, [1, 4_990 - i][i % 2]) for i in range(300)]
    df = spark.createDataFrame(rows, "budget_key string, request_id string, seq long, amount long").repartition(5)
    done = vr.budget_fold(df, spark.createDataFrame(list(limits.items()), "budget_key string, limit long"), block).collect()
    got = {(r.budget_key, r.seq): (r.accepted, r.reserved) for r in done}
    assert len(done) == len(rows)
    for k, limit in limits.items():
        used = 0
        for _, _, i, a in [r for r in rows if r[0] == k]:
            ok = a is not None and 0 <= a <= limit - used
            used += a if ok else 0
            assert got[k, i] == (ok, used if ok else None), (k, i)


def test_budget_ledger_settles_and_releases(spark):
    entries = [("x", "a", 1, "reserve", 40), ("x", "b", 2, "reserve", 30), ("x", "a", 3, "settle", 45), ("x", "b", 4, "reserve", 30), ("x", "b", 5, "release", None),
               ("x", "a", 6, "correct", -20), ("x", "b", 7, "settle", 5), ("x", "b", 8, "reserve", 60), ("x", "c", 9, "correct", 1), ("y", "a", 1, "reserve", 1)]
    e = spark.createDataFrame(entries, "budget_key string, task_id string, seq long, kind string, amount long")
    b = spark.createDataFrame([("x", 90, 10), ("y", 0, None)], "budget_key string, limit long, opening long")
    got = [(r.budget_key, r.seq, r.accepted, r.reserved, r.spent) for r in vr.budget_ledger(e, b).orderBy("budget_key", "seq").collect()]
    assert got == [("x", 1, True, 40, 10), ("x", 2, True, 70, 10), ("x", 3, True, 30, 55), ("x", 4, False, 30, 55), ("x", 5, True, 0, 55), ("x", 6, True, 0, 35),
                   ("x", 7, False, 0, 35), ("x", 8, False, 0, 35), ("x", 9, False, 0, 35), ("y", 1, False, 0, 0)][:7] + [("x", 8, 60 + 35 <= 90, 0, 35), ("x", 9, False, 0, 35), ("y", 1, False, 0, 0)]


def test_digests_tell_separators_and_nulls_apart(spark):
    rows = [("x|b=y", "z"), ("x", "y|b=z"), (None, "z"), ("\\N", "z"), ("~", "z"), ("1:z", ""), ("1", ":z")]
    d = vr.fingerprint(spark.createDataFrame(rows, "a string, b string"), ["a", "b"])
    assert d.select("digest").distinct().count() == len(rows)


def test_lineage_marks_cycles(spark):
    v = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 9), (10, 11), (11, 10), (12, 10), (20, 20)], "variant_id long, parent_id long")
    got = {r.variant_id: (r.root_id, r.depth, r.finding) for r in vr.lineage(v).collect()}
    bad = (None, None, "LINEAGE_CYCLE")
    assert got == {1: (1, 0, None), 2: (1, 1, None), 3: (1, 2, None), 4: (9, 1, None), 10: bad, 11: bad, 12: bad, 20: bad}


def test_character_references_and_wide_blanks(spark):
    texts = ["&#8217;x &#x41;&#X42;", "&#0; &#xD800; &#1114112; &#99999999999;", "a&#39;b &#39 &# ; &#x; &#12ab;", "\u3000冲突\u3000", "a&lt;b&amp;#65;", "&#128512;!"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", tf.unescape("t").alias("n"), tf.strip("t").alias("s"), tf.clean_text("t").alias("c")).collect()
    got = {r.t: r for r in rows}
    assert [got[t].n for t in texts[:3]] == ["’x AB", "\ufffd \ufffd \ufffd \ufffd", "a'b ' &# ; &#x; \x0cab;"]
    assert got[texts[3]].s == "冲突" and got[texts[4]].c == "a<b&#65;" and got[texts[5]].n == "😀!"


def test_references_read_as_the_standard_says(spark):
    rng = random.Random(1)
    texts = ["caf&eacute; &mdash;", "&#146; &#38;lt; &amp;lt; &notit; &not &notin; &x; & &;", "&#13; &#11; &#x80; &#x81; &ampx &AMP &Amp; &#xfffe; &#x1ffff; a&b=c&copy=1"]
    for _ in range(300):
        names = rng.sample(sorted(html.entities.html5), 2)
        texts.append("".join(rng.choice(["&" + names[0], "&" + names[1][:-1], f"&#{rng.randint(0, 300)};", f"&#x{rng.randint(0, 0x11FFFF):x};", " ", "x", "&", ";", "é<b"]) for _ in range(8)))
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", tf.unescape("t").alias("u")).collect()
    assert {r.i: r.u for r in rows} == {i: html.unescape(t) for i, t in enumerate(texts)}


def test_literals_of_every_length_equal_contains(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("aé ") for _ in range(rng.randint(1, 4)))
    texts = [" ".join(word() for _ in range(rng.randint(0, 12))) for _ in range(60)]
    needles = [t[k : k + rng.randint(1, 14)] for t in texts[:40] for k in [rng.randint(0, max(0, len(t) - 2))]] + ["a", "é a", "zz", " ", "aéaé"]
    t = spark.createDataFrame(list(enumerate(texts)), "text_id int, text string")
    n = spark.createDataFrame(list(enumerate(needles)), "needle_id int, text string")
    got = sorted((r.text_id, r.needle_id) for r in tx.literal_pairs(n, t).collect())
    assert got == sorted((i, k) for i, x in enumerate(texts) for k, y in enumerate(needles) if y and y in x)


def test_median_of_a_hot_key(spark):
    rng = random.Random(2)
    rows = [("hot", rng.randint(-10**9, 10**9)) for _ in range(1001)] + [("even", v) for v in (5, 1, 9, 1)] + [("one", 7), ("none", None)]
    got = {r.k: r.m for r in sg.exact_median(spark.createDataFrame(rows, "k string, v long"), ["k"], "v", "m").collect()}
    assert got == {"hot": sorted(v for k, v in rows if k == "hot")[500], "even": 3.0, "one": 7.0}


def test_three_way_cases(spark):
    ddl = "work_id string, clip_id string, a long, b long"
    base = spark.createDataFrame([("w", "same", 1, 1), ("w", "host", 1, 1), ("w", "cur", 1, 1), ("w", "both", 1, 1), ("w", "conv", 1, 1), ("w", "lost", 1, 1)], ddl)
    cur = spark.createDataFrame([("w", "same", 1, 1), ("w", "host", 1, 1), ("w", "cur", 2, 1), ("w", "both", 2, 1), ("w", "conv", 5, 1), ("w", "lost", 1, 1)], ddl)
    host = spark.createDataFrame([("w", "same", 1, 1), ("w", "host", 1, 9), ("w", "cur", 1, 1), ("w", "both", 3, 1), ("w", "conv", 5, 1), ("w", "new", 1, 1)], ddl)
    ch = vr.three_way(base, cur, host, ["work_id", "clip_id"], ["a", "b"])
    assert sorted((r.clip_id, r.field, r.kind) for r in ch.collect()) == [("both", "a", "conflict"), ("conv", "a", "converged"), ("cur", "a", "current_only"), ("host", "b", "host_only"), ("lost", "presence", "host_only"), ("new", "presence", "unconfirmed_new")]
    none = base.where("false").select("work_id", "clip_id")
    ok, blocked = vr.proposals(ch, ["work_id", "clip_id"], none, ["a"], none)
    assert [(r.clip_id, r.field) for r in ok.collect()] == [("host", "b")]
    assert sorted(r.clip_id for r in blocked.collect()) == ["both", "lost", "new"]


def test_only_asked_terms_are_kept(spark):
    terms = spark.createDataFrame([("u1", "a"), ("u1", "b"), ("u2", "b"), ("u2", "b"), ("u3", None)], "unit_id string, term string")
    kept = rs.asked(terms, spark.createDataFrame([("x", "b"), ("y", "b"), ("y", None), ("y", "z")], "beat_id string, term string"))
    assert kept.columns == terms.columns and sorted(map(tuple, kept.collect())) == [("u1", "b"), ("u2", "b"), ("u2", "b")]
