"""Class model, packing, links, wrappers, components and the pipeline against plain versions."""

import math
import random
import re
import tracemalloc
import zlib
from array import array
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from spanframe.llm import classes as class_model
from spanframe.llm.classes import best_classes, exchange, likelihood, score_captions, weigh
from spanframe.llm.components import components
from spanframe.llm.copies import find_near_copies
from spanframe.llm.leaks import find_leaks
from spanframe.llm.links import judge_links
from spanframe.llm.packing import best_fit, encoder, pack_transcripts, plan_sequences
from spanframe.llm.wrappers import Block, common, extract_pages, host_wrappers, parse

BLANK = re.compile(r"[^\x20\x09-\x0D]+")
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def test_base_scores_equal_brute_force_and_classes_help(spark):
    rng = random.Random(1)
    kinds = {"a": [f"ka{i}" for i in range(30)], "b": [f"mo{i}" for i in range(30)]}
    rows = []
    for i in range(300):
        turn = rng.random() < 0.5
        words = []
        for _ in range(rng.randint(0, 60)):
            turn = not turn
            words.append(rng.choice(kinds["a" if turn else "b"]))
        rows.append((i, " ".join(words) + rng.choice(["", " Unseen%d" % i, "\n"]), i % 5 != 1))
    rows += [(900, None, True), (901, "", False), (902, "KA1 ka1", None), (902, "KA1 ka1", None)]
    got = score_captions(spark.createDataFrame([(*r, 1) for r in rows], "caption_id long, text string, train boolean, n_known int"), n_classes=4).collect()
    count = Counter(t for _, x, train in rows if train for t in [*BLANK.findall(lower(x)), None])
    n, v = sum(count.values()), len(count)
    by = {i: x for i, x, _ in rows}
    assert len(got) == len(rows)
    for r in got:
        tokens = [*BLANK.findall(lower(by[r.caption_id])), None]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tokens), sum(count[t] > 0 for t in tokens), n)
        assert math.isclose(r.base_score, sum(math.log10((count[t] + 0.5) / (n + 0.5 * (v + 1))) for t in tokens), rel_tol=1e-9)
    held = [r for r in got if not r.train]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)  # the alternation is only in the classes
    empty = spark.createDataFrame([], "caption_id long, text string, train boolean")
    assert score_captions(empty).count() == 0
    untaught = score_captions(spark.createDataFrame([(1, "a b", False)], "caption_id long, text string, train boolean")).first()
    assert untaught.train_tokens == 0 and untaught.n_known == 0 and untaught.base_score == 0.0


def test_exchange_does_not_lower_the_likelihood():
    rng = np.random.default_rng(2)
    pairs = np.zeros((1281, 1281), np.int64)
    pairs[:40, :40] = rng.poisson(3, (40, 40))
    for i in range(40):
        pairs[i, (i % 2 == 0) * 20 : (i % 2 == 0) * 20 + 20] += 30
    pairs[1280, :5], pairs[:5, 1280] = 7, 7

    def value(classes):
        t = np.zeros((8, 8))
        np.add.at(t, (classes[:, None], classes[None, :]), pairs)
        return weigh(t).sum() - weigh(t.sum(0)).sum() - weigh(t.sum(1)).sum()

    start, after = exchange(pairs, 8, 0), exchange(pairs, 8)
    assert value(after) > value(start) and after[1280] == 7 and (after[:1280] < 7).all()


def test_each_word_takes_its_best_class():
    rng = np.random.default_rng(5)
    pairs, k = rng.poisson(0.4, (30, 30)).astype(float), 5
    of = rng.integers(0, k - 1, 30)
    of[29] = k - 1

    def table(c):
        t = np.zeros((k, k))
        np.add.at(t, (c[:, None], c[None, :]), pairs)
        return t

    after, before = np.zeros((30, k)), np.zeros((30, k))
    for w in range(30):
        for v in range(30):
            if v != w:
                after[w, of[v]] += pairs[w, v]
                before[w, of[v]] += pairs[v, w]
    got = best_classes(table(of), of, after, before, np.diagonal(pairs).copy())
    for w in range(29):
        value = [likelihood(table(np.where(np.arange(30) == w, c, of))) for c in range(k - 1)]
        assert math.isclose(value[got[w]], max(value), rel_tol=1e-12)


def test_rows_of_neighbours_take_little_memory():
    """All neighbours of a full list of tokens, at a peak of a few bytes a token besides the slice in hand."""
    rng = np.random.default_rng(7)
    chain = array("i", np.append(0, rng.integers(1, 200_001, class_model.TOKENS)).astype(np.int32).tobytes())
    codes = [class_model.END_CODE, *(class_model.head_code(k, b"%d" % k) for k in range(100_000)), *(class_model.code_of(b"%d" % k) for k in range(100_000, class_model.FLUSH))]
    total = rows = 0
    tracemalloc.start()
    for b in class_model.neighbour_rows(codes, chain):
        _, near, n = class_model.entries(b)
        total += int(n[class_model.counted(near)].sum())
        rows += b.num_rows
        assert (np.diff(b.column("code").to_numpy()) > 0).all()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert total == class_model.TOKENS and rows > 20_000
    assert peak < 180e6  # all pairs at once, as before, took 467 MB through neighbours


def test_rare_words_have_classes_of_their_own(spark):
    rng = random.Random(6)
    rows = []
    for i in range(600):  # 3000 words of one ending; the kinds alternate
        rows.append((i, " ".join(f"{'ab'[j % 2]}{min(int(1500 * rng.random() ** 1.5), 1499)}zz" for j in range(rng.randint(50, 100))), True))
    rows += [(1000 + i, " ".join(f"{'ab'[j % 2]}{rng.randint(1200, 1499)}zz" for j in range(60)), False) for i in range(20)]
    table = spark.createDataFrame(rows + [(2000, "new1zz a1zz new2zz b1499zz", False)], "caption_id long, text string, train boolean")
    got = {}
    for most in (class_model.HEAD, 2_000, 0):  # fewer in the head: counts and classes of the others come by the join
        got[most] = {r.caption_id: r for r in score_captions(table, n_classes=4, head_words_most=most).collect()}
        held = [r for r in got[most].values() if 1000 <= r.caption_id < 2000]
        if most:
            assert sum(r.score - r.base_score for r in held) > 0.2 * sum(r.n_tokens for r in held)  # of log10(2) a token
    for r in table.collect():
        a, b, c = (got[m][r.caption_id] for m in got)
        assert a.n_known == b.n_known == c.n_known
        assert math.isclose(a.base_score, b.base_score, rel_tol=1e-9) and math.isclose(a.base_score, c.base_score, rel_tol=1e-9)


@pytest.mark.parametrize("most", [class_model.HEAD, 1_300, 0])
def test_scores_equal_brute_force_given_the_classes(spark, most):
    """Class counts over all pairs of words, emissions and scores, from the classes that clustering gives."""
    rng, k = random.Random(15), 6
    words = [f"{a}{i}{e}" for i in range(300) for a in "xyz" for e in ("a", "bé", "c!")]
    rows = [(i, " ".join(rng.choice(words[: rng.choice([40, 2700])]) for _ in range(rng.randint(0, 60))), i % 4 != 1) for i in range(300)]
    rows += [(900, None, True), (901, "", True), (902, "same same same", True)]
    table = spark.createDataFrame(rows, "caption_id long, text string, train boolean")
    training = table.where("train").select(F.col("text").cast("binary").alias("raw"))
    head = class_model.head_words(class_model.word_counts(training), most)
    codes = {w: class_model.head_code(r, w) for r, (w, _) in enumerate(head)}
    seeds, groups, classes, counts = class_model.cluster(class_model.contexts(class_model.neighbours(training, codes)), k)
    far = {r.code: r["class"] for r in classes.collect()}

    def group(w):
        w = w.encode()
        return groups[codes[w] >> class_model.ITEM_BITS] if w in codes else far.get(class_model.code_of(w), seeds[class_model.item_of(w)])

    chain, count, pairs = [None], Counter(), np.zeros((k, k))
    for _, x, train in rows:
        if train:
            chain += [*BLANK.findall(x or ""), None]
    count.update(chain[1:])
    of = lambda w: k - 1 if w is None else int(group(w))
    for a, b in zip(chain, chain[1:], strict=False):
        pairs[of(a), of(b)] += 1
    texts_end = lambda c: c.sum()
    assert texts_end(counts) >= texts_end(pairs) and np.abs(counts - pairs).sum() <= 16  # tasks start at an end of their own
    move, tokens, kinds = class_model.class_tables(counts), np.zeros(k), np.zeros(k)
    for w, n in count.items():
        tokens[of(w)] += n
        kinds[of(w)] += 1
    got = {r.caption_id: r.score for r in score_captions(table, n_classes=k, head_words_most=most).collect()}
    for i, x, _ in rows:
        line, want = [None, *BLANK.findall(x or ""), None], 0.0
        for a, b in zip(line, line[1:], strict=False):
            want += move[of(a), of(b)] + math.log10((count[b] + 0.5) / (tokens[of(b)] + 0.5 * (kinds[of(b)] + 1)))
        assert math.isclose(got[i], want, rel_tol=1e-9), (i, got[i], want)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=30))
def test_plans_use_each_length_as_often_as_it_occurs(histogram):
    for plan in (plan_sequences(histogram, 64), best_fit({k: v for k, v in histogram.items()}, 64)):
        used = Counter()
        for pieces, n in plan:
            assert n > 0 and sum(pieces) <= 64
            for p in pieces:
                used[p] += n
        assert +used == Counter(histogram)
    total = sum(k * v for k, v in histogram.items())
    assert sum(n for _, n in plan_sequences(histogram, 64)) <= 2 * -(-total // 64) + 1


def test_ids_of_long_runs_equal_the_library():
    plain = Tokenizer.from_file(TOKENIZER)
    plain.encode_special_tokens = True
    for n in (998, 999, 1000, 1001, 2500):
        for blank in (" ", "\n", " \n\t", "\u00a0", "\u3000 "):
            for text in (blank * n, "a" + blank * n, blank * n + "b c", f"a,{blank * n}b{blank * n}!{blank * n}7 x"):
                assert encoder(TOKENIZER)(text) == plain.encode(text, add_special_tokens=False).ids
    for long in (" ", "\n", "a", "1", "!", " \n", "a b", "é"):
        text = long * (2_000_000 // len(long))
        ids = encoder(TOKENIZER)(text)
        assert len(ids) > 0 and plain.decode(ids, skip_special_tokens=False) == text


def test_packing_is_an_exact_round_trip(spark):
    rng = random.Random(4)
    plain = Tokenizer.from_file(TOKENIZER)
    texts = ["".join(rng.choice("ab cdé\n 12 ,.ñ中") for _ in range(rng.choice([0, 5, 40, 300, 900]))) for _ in range(80)]
    rows = [*enumerate(texts), (900, None), (0, texts[0]), (901, "<|endoftext|> it's  \t 's"), (902, "x" * 3000)]
    table = spark.createDataFrame([(i, t, 3) for i, t in rows], "source_id long, text string, piece int")
    pieces, places = pack_transcripts(table, TOKENIZER, length=64)
    got = pieces.join(places, ["row_no", "piece"]).collect()
    by = defaultdict(list)
    for r in got:
        by[r.row_no].append(r)
    plain.encode_special_tokens = True
    want = Counter((i, tuple(plain.encode(t or "", add_special_tokens=False).ids) + (0,)) for i, t in rows)
    whole = Counter()
    for parts in by.values():
        parts.sort(key=lambda r: r.piece)
        assert [r.start for r in parts] == [sum(p.length for p in parts[:k]) for k in range(len(parts))]
        assert all(r.length == 64 for r in parts[1:]) and all(r.length * 4 == len(r.ids) <= 256 for r in parts)
        whole[parts[0].source_id, tuple(np.frombuffer(b"".join(bytes(r.ids) for r in parts), "<u4").tolist())] += 1
    assert whole == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for s in sequences.values():
        s.sort()
        assert [o for o, _ in s] == [sum(n for _, n in s[:k]) for k in range(len(s))] and sum(n for _, n in s) <= 64
    sizes = Counter(r.length for r in got)
    assert len(sequences) <= 1.01 * sum(n for _, n in best_fit(dict(sizes), 64)) + 1
    empty = pack_transcripts(table.limit(0), TOKENIZER)
    assert empty[0].count() == 0 and empty[1].count() == 0


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet=st.characters(blacklist_categories=("Cs",)), max_size=200))
def test_fast_ids_equal_the_tokenizer_library(text):
    plain = Tokenizer.from_file(TOKENIZER) if "plain" not in globals() else globals()["plain"]
    globals()["plain"] = plain
    plain.encode_special_tokens = True
    assert encoder(TOKENIZER)(text) == plain.encode(text, add_special_tokens=False).ids


RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block")]


def test_link_rules_and_mined_combinations(spark):
    urls = ["http://a.example.com/en/x", "http://WWW.Example.com/en/x", "https://q.com/", "http://q.com", "ftp://net/es/1?a=b://c/", "no scheme", None, "", "x://", "http://exampleXcom/en/", "http://b.net/ES/", "http://u.net/es/#a?b", "a\nb://net/es/"]
    rows = list(enumerate(urls)) + [(0, urls[0])]
    got = judge_links(spark.createDataFrame([(i, u, 0) for i, u in rows], "link_id long, url string, host int"), RULES).collect()
    assert len(got) == len(rows)
    for r in got:
        u = r.url or ""
        rest = u.partition("://")[2]
        host = lower(re.match(r"[^/?#]*", rest).group())
        path = re.match(r"[^?#]*", rest[len(host) :]).group()
        fits = [(len(h + p), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        want = max(fits, default=(0, None, "allow"))
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, want[1], want[2]), r
    many = [(i, f"http://s{i}.{'com' if i % 2 else 'net'}/{'en' if i % 2 else 'es'}/casino/{i}") for i in range(100)]
    many += [(1000 + i, f"http://t{i}.org/{x}/n") for i, x in enumerate(["es", "en", "de"])]
    found = {r.link_id: r for r in judge_links(spark.createDataFrame(many, "link_id long, url string"), RULES).collect()}
    assert found[1000].verdict == "block" and found[1000].matched == "path:es" and found[1000].confidence == 1.0
    assert found[1001].verdict == "allow" and found[1001].matched == "path:en" and found[1002].matched is None
    assert judge_links(spark.createDataFrame([], "link_id long, url string"), RULES).count() == 0


def page(rng, k, extra=""):
    words = lambda n: " ".join(rng.choice("ka lo mi nu &amp; pre &#233;t".split()) for _ in range(n))
    body = "".join(f"<p>{words(rng.randint(4, 20))} <b>{words(2)}</b>\n{words(2)}</p>" for _ in range(rng.randint(1, 5)))
    menu = "".join(f"<li><a href=/x>{words(1)}</a></li>" for _ in range(rng.randint(2, 5)))
    html = (f"<!doctype html><html><head><title>{words(3)}</title><style>p{{}}</style><script>var a='</p>';</script></head><body><div class=cookie-notice>{words(3)}</div>"
            f"<nav><ul>{menu}</ul></nav><div class='content'><h1>{words(4)}</h1>{body}<div class=ad>{words(4)}</div>{extra}</div>"
            f"<section id=comments><p>{words(9)}</p></section><footer>{words(5)}</footer></body></html>")
    text = re.sub(r"<[^>]*>", "", re.sub(r"</?(?:p|h1)>", " ", re.search(r"<h1>.*(?=<div class=ad>)", html, re.S).group()))
    return html, " ".join(text.replace("&amp;", "&").replace("&#233;", "é").split())


def test_wrappers_extract_the_article(spark):
    rng = random.Random(6)
    rows = []
    for k in range(40):
        html, text = page(rng, k, "<table><tr><td>" if k % 7 == 0 else "")
        rows.append((k, f"http://h{k % 3}.example.org/{k}", html, text))
    rows += [(900, "http://h0.example.org/e", None, ""), (901, None, "", ""), (902, "no host", "plain <b>te</b>xt", "plain text"), (903, "http://one.example/x", "<article><p>a<p>b <i>c</i></article><aside>d</aside>", "a b c"),
             (904, "http://h1.example.org/cut", rows[1][2][: rows[1][2].index("</h1>")], re.search(r"<h1>(.*?)</h1>", rows[1][2]).group(1).replace("&amp;", "&").replace("&#233;", "é"))]
    table = spark.createDataFrame([(i, u, h, "t") for i, u, h, _ in rows], "page_id long, url string, html string, text string")
    for limit in (32 << 20, 0):
        got = {r.page_id: r.text for r in extract_pages(table, broadcast_bytes=limit).collect()}
        assert got == {i: t for i, _, _, t in rows}
    assert extract_pages(table.limit(0)).count() == 0


def test_wrappers_find_repeats_and_optional_groups(spark):
    blocks = parse("<ul><li>a<li>b</ul><dl><dt>a<dd>b<dt>c<dd>d</dl><p>x</p>")[0].shape().split("\n")
    assert blocks == [" 3", "ul 1", "li+ 1", "# 0", "dl 1", "(dt dd)+ 2", "dt 1", "# 0", "dd 1", "# 0", "p 1", "# 0"]
    pages = spark.createDataFrame([("h", "<p>a</p>"), ("h", "<h1>t</h1><p>b</p><p>c</p>"), ("g", "<p>z</p>")], "host string, html string")
    found = {r.host: r.wrapper for r in host_wrappers(pages).collect()}
    assert set(found) == {"h", "g"} and '"h1", ' in found["h"]
    tree = parse("<ul><li>a<p>b</p></ul><h2>c</h2>" * 3)[0]
    assert Block.unpack(tree.pack()).shape() == tree.shape()


def labelled_page(rng, template, words):
    """A page of a template and its article, built side by side from labelled blocks."""
    quote = rng.choice(["'{}'", '"{}"', "{}"])
    block = lambda tag, name, inner: f"<{tag}{f' class={quote.format(name)}' if name else ''}>{inner}</{tag}>"
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    kept, out = [], []

    def add(tag, name="", n=8, keep=True):
        t = text(n)
        out.append(block(tag, name, t))
        if keep:
            kept.append(t)

    add("h1", "", 4)
    for _ in range(rng.randint(1, 6)):
        add(rng.choice(["p", "p", "h2", "blockquote", "pre"]), rng.choice(["", "", "lead"]))
        if rng.random() < 0.4:
            add("div", rng.choice(["ad", "share", "comments", "related"]), 5, False)
    body = block(*template["region"], "".join(out))
    around = block("nav", "", f"<ul><li><a href=/>{text(1)}</a></li></ul>") + block("div", "cookie-notice", text(5))
    foot = block("section", "comment-list", text(9)) * rng.randint(0, 1) + block("footer", "", text(3))
    return f"<html><body>{around}{block('div', template['wrap'], body)}{foot}</body></html>", " ".join(kept)


TEMPLATES = [
    {"region": ("article", "news"), "wrap": "page"}, {"region": ("article", "blog"), "wrap": "page"}, {"region": ("main", ""), "wrap": "outer"},
    {"region": ("div", "story"), "wrap": "outer"}, {"region": ("article", ""), "wrap": "left"},
]


def test_each_template_of_a_host_keeps_its_articles(spark):
    rng, words = random.Random(12), "ka lo mi nu pre stra tion be".split()
    rows = []
    for k in range(160):
        html, text = labelled_page(rng, TEMPLATES[k % 5 if k % 4 else 0], words)
        rows.append((k, f"http://h{k % 2}.example.org/{k}", html, text))
    table = spark.createDataFrame([r[:3] for r in rows], "page_id long, url string, html string")
    one = {r.page_id: r.text for r in extract_pages(table.coalesce(1)).collect()}
    assert one == {r[0]: r[3] for r in rows}
    wrappers = lambda parts: {r.host: r.wrapper for r in host_wrappers(table.repartition(parts).select(F.split("url", "/")[2].alias("host"), "html")).collect()}
    assert wrappers(1) == wrappers(7)  # however pages are dealt out


def test_deep_wide_and_oddly_quoted_pages(spark):
    rng = random.Random(3)
    wide = lambda: "<main>" + "".join(f"<p class={rng.choice('efghijkl')}{rng.choice('qrtuvwxz')}>x</p><div>y</div>" for _ in range(2500))
    rows = [
        (1, "<main>" + "<div>" * 100_000 + "deep"), (2, "<main>" + "<div>" * 1_200 + "less deep"), (3, "<main><p>flat</p>"), (4, "</div>" * 50_000 + "<main>ends</main>"),
        (5, "<article>a<div class='ad'>b</div><div id = 'comments'>c</div><div class=ads>d</div><div class=''>e</div><div class=\"x\" id='sidebar'>f</div></article>"),
        (6, wide()), (7, wide()),
    ]
    table = spark.createDataFrame([(i, "http://d.org/", h) for i, h in rows], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in extract_pages(table).collect()}
    assert [got[k] for k in range(1, 6)] == ["deep", "less deep", "flat", "ends", "a e"]
    assert got[6].split() == got[7].split() == ["x", "y"] * 2500


def test_common_subsequences_are_in_order():
    rng = random.Random(4)
    for n in (0, 1, 5, 40, 700):
        a, b = [[rng.choice("abcdef") + rng.choice(["", str(rng.randrange(n + 1))]) for _ in range(n)] for _ in range(2)]
        pairs = common(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:], strict=False))
    assert common(list("xabcy"), list("zabcw")) == [(1, 1), (2, 2), (3, 3)]


def test_components_equal_union_find(spark):
    rng = random.Random(8)
    pairs = [(i, i + 1) for i in range(0, 200)] + [(rng.randrange(300, 900), rng.randrange(300, 900)) for _ in range(300)] + [(5, 5), (1000, 1001)]
    root = {x: x for p in pairs for x in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        p, q = sorted((find(a), find(b)))
        root[q] = p
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs * 2, "a long, b long")).collect()}
    alone = {a for a, b in pairs if a == b and all(a not in p or p == (a, a) for p in pairs)}
    assert got == {x: find(x) for x in root if x not in alone}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def documents(spark):
    rng = random.Random(9)
    words = {"en": "the of and to in is that it for was".split(), "de": "der die und das ist nicht mit von zu ein".split()}
    long = {k: [a + b for a in v for b in v] + v for k, v in words.items()}
    text = lambda lang, n: "".join(rng.choice(long[lang]) + rng.choice([" ", " ", " ", ". ", ".\n"]) for _ in range(n)).strip()
    rows = [(i, text("en" if i % 3 else "de", rng.randint(60, 150)), "en" if i % 3 else "de", f"s{i % 4}") for i in range(160)]
    item = text("en", 30).replace("\n", " ")
    rows[7] = (7, rows[7][1] + " " + item, "en", "s0")
    near = rows[11][1].replace("\n", " ").split(" ")
    rows[11] = (11, " ".join(near), "en", "s1")
    rows[12] = (12, " ".join([*near[:20], "otherword", *near[21:]]), "en", "s1")
    passage = " ".join(text("en", 70).split())
    for i in (20, 21, 22):
        rows[i] = (i, rows[i][1] + "\n" + passage + "\nend " + str(i), "en", "s2")
    rows += [(900, None, "en", None), (901, "123 !!", None, "s1"), (902, "Жзц щъю " * 60, None, "s0"), (903, rows[30][1], "en", "s3")]
    docs = spark.createDataFrame([(*r, len(r[1] or ""), "z") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, start string")
    return docs, rows, item, passage


def test_pipeline_stages(spark, tmp_path):
    docs, rows, item, passage = documents(spark)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "line dedup", "MinHash near-dedup", "benchmark decontamination", "best-fit packing"]
    at, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for name, stage in corpus_pipeline.STAGES:
        at = corpus_pipeline.written(stage(spark, at, str(tmp_path)), name.replace(" ", "-"))
        seen.append(at)
    ids = [{r.doc_id for r in d.select("doc_id").collect()} for d in seen]
    every = {r[0] for r in rows}
    assert ids[0] == every - {900, 901, 902}
    assert ids[1] == ids[0] - {903} or ids[1] == ids[0]
    texts = {r.doc_id: r for r in seen[1].collect()}
    assert sum(passage in r.text for r in texts.values()) == 1 and all(r.n_chars == len(r.text) for r in texts.values())
    copies = find_near_copies(seen[1].withColumnRenamed("doc_id", "segment_id")).where("not kept")
    assert ids[2] == ids[1] - {r.segment_id for r in copies.collect()} and 12 not in ids[2] and 11 in ids[2]
    leaks = find_leaks(seen[2].withColumnRenamed("doc_id", "segment_id"), spark.createDataFrame([(1, item)], "case_id long, text string")).where("size(spans) > 0")
    assert ids[3] == ids[2] - {r.segment_id for r in leaks.collect()} and ids[2] - ids[3] == {7}
    assert ids[4] == ids[3]
    assert all(d.columns == corpus_pipeline.COLUMNS for d in seen[:-1])
    for r in seen[-1].collect():
        assert r.ids_crc32 == zlib.crc32(bytes(r.ids)) and r.length * 4 == len(r.ids)
    assert corpus_pipeline.run(spark, str(tmp_path)).select(F.count("*"), F.sum("length")).first() == seen[-1].select(F.count("*"), F.sum("length")).first()
    nothing = seen[0].limit(0)
    for name, stage in corpus_pipeline.STAGES:
        nothing = corpus_pipeline.written(stage(spark, nothing, str(tmp_path)), name.replace(" ", "-"))
    assert nothing.count() == 0
