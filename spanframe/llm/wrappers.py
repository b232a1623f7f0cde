"""HTML extraction: union-free wrappers of each host, inferred by aligning the block structure of its pages."""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, written
from .links import split_link

# HTML's block elements, elements with raw text, elements that are no article text.
BLOCKS = set("""address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset
h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav object ol optgroup option p pre search section select summary svg table tbody td
template tfoot th thead title tr ul canvas audio video math""".split())
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes"}
VOID = {"hr", "br", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr", "param"}
NOISE_TAGS = set("""nav footer aside form menu dialog button select option optgroup label fieldset legend svg canvas object template noscript head title script
style iframe textarea audio video math search""".split())
NOISE_WORDS = set("""ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner menu menus nav navbar navigation breadcrumb breadcrumbs
sidebar footer cookie cookies consent notice notices alert gdpr popup modal overlay newsletter subscribe signup login share sharing social related recommended
recommendations comment comments reply replies respond discussion pagination pager toolbar widget widgets search copyright legal disclaimer""".split())
MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>?|([^<]+|<)", re.S)
NAMES = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
NODES = 5_000  # blocks of a wrapper from which on rare ones are left to the pages that have them
RARE = 20  # a block on fewer than one in so many pages is rare, so a wrapper has at most that many times a page's blocks
CELLS = 250_000  # of two block sequences up to this product the longest common one is found, beyond it between unique blocks


class Block:
    """A block of a page or wrapper: signature, children, text measures, pages, whether it repeats.

    ``has`` and ``sums`` are filled by ``measure``.  Trees may be deeper than Python's stack:
    whatever visits them keeps a list of its own.
    """

    __slots__ = ("sig", "kids", "leaves", "chars", "links", "text", "pages", "many", "has", "sums")

    def __init__(self, sig: str, kids: list[Block] | None = None, leaves=(), chars=0, links=0, text=0, pages=1, many=False):
        self.sig, self.kids, self.leaves = sig, kids if kids is not None else [], list(leaves)
        self.chars, self.links, self.text, self.pages, self.many = chars, links, text, pages, many
        self.has, self.sums = False, ((0, 0), (0, 0))

    def below(self) -> list[Block]:
        """The block and all under it, in page order."""
        out, todo = [], [self]
        while todo:
            b = todo.pop()
            out.append(b)
            todo.extend(reversed(b.kids))
        return out

    def pack(self) -> str:
        rows = [(b.sig, b.chars, b.links, b.text, b.pages, b.many, len(b.kids)) for b in self.below()]
        return json.dumps(list(zip(*rows, strict=True)))

    @staticmethod
    def unpack(packed: str) -> Block:
        columns = json.loads(packed)
        blocks = [Block(sig, None, (), *rest) for sig, *rest in zip(*columns[:6], strict=True)]
        todo, counts = [], columns[6]
        for b, n in zip(blocks, counts, strict=True):
            if todo:
                todo[-1][0].kids.append(b)
                todo[-1][1] -= 1
            todo.append([b, n])
            while todo and todo[-1][1] == 0:
                todo.pop()
        return blocks[0]

    def shape(self) -> str:
        return "\n".join(f"{b.sig}{'+' if b.many else ''} {len(b.kids)}" for b in self.below())


def signature(tag: str, attributes: str) -> str:
    values = [next(v for v in m.groups()[1:] if v is not None) for m in NAMES.finditer(attributes)]
    return tag + "".join("." + re.sub(r"\d+", "0", " ".join(v.split())) for v in values)


def parse(page: str) -> tuple[Block, list[str]]:
    """The block tree of a page, folded, and the text of its leaves in page order.

    A leaf ``#`` is a run of inline content between block borders. Inline tags are no
    structure; ``a`` only counts its characters as links, ``br`` is white space.
    """
    root = Block("")
    stack: list[tuple[str, Block]] = [("", root)]
    texts: list[str] = []
    run: list[str] = []
    link, linked, end = False, 0, 0

    def close_run() -> None:
        nonlocal linked
        text = " ".join(entities.unescape("".join(run)).split())
        if text:
            stack[-1][1].kids.append(Block("#", None, [len(texts)], len(text), min(linked, len(text)), zlib.crc32(text.encode("utf-8", "replace")) + 1))
            texts.append(text)
        run.clear()
        linked = 0

    open_at: dict[str, list[int]] = {}

    def pop_to(depth: int) -> None:
        while len(stack) > depth:
            tag, b = stack.pop()
            open_at[tag].pop()
            b.kids = fold(b.kids)

    at = 0
    while m := MARKUP.search(page, at):
        at = m.end()
        if m[4] is not None:
            run.append(m[4])
            linked += len(m[4]) * link
            continue
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "a":
                link = False
            elif tag in BLOCKS:
                close_run()
                if open_at.get(tag):
                    pop_to(open_at[tag][-1])
            continue
        if tag in RAW:
            close_run()
            end = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(page, at)
            at = end.start() if end else len(page)
            closing = page.find(">", at)
            at = closing + 1 if end and closing >= 0 else len(page)
            continue
        if tag in BLOCKS or "-" in tag:
            close_run()
            if open_at.get("p") and (stack[-1][0] == "p" or tag != "svg"):
                pop_to(open_at["p"][-1])
            if tag in ("li", "dd", "dt", "option", "tr", "td", "th") and stack[-1][0] in ({"dd", "dt"} if tag in ("dd", "dt") else {"td", "th"} if tag in ("td", "th") else {tag}):
                pop_to(len(stack) - 1)
            block = Block(signature(tag, m[3]))
            stack[-1][1].kids.append(block)
            if tag not in VOID and not m[3].endswith("/"):
                open_at.setdefault(tag, []).append(len(stack))
                stack.append((tag, block))
        elif tag == "a":
            link = True
        elif tag == "br":
            run.append(" ")
    close_run()
    pop_to(1)
    root.kids = fold(root.kids)
    return root, texts


def join(a: Block, b: Block, same_page: bool) -> Block:
    """Merges block ``b`` into ``a``, and what is under them by alignment."""
    todo = [(a, b)]
    while todo:
        x, y = todo.pop()
        x.leaves += y.leaves
        x.chars, x.links = x.chars + y.chars, x.links + y.links
        x.text = x.text if x.text == y.text and not same_page else 0
        x.pages, x.many = (x.pages if same_page else x.pages + y.pages), x.many or y.many
        x.kids, pairs = align(x.kids, y.kids)
        todo += pairs
    return a


def fold(kids: list[Block]) -> list[Block]:
    """Turns adjacent equal blocks, and adjacent equal groups of two or three, into repeated ones."""
    out: list[Block] = []
    for k in kids:
        if out and out[-1].sig == k.sig:
            join(out[-1], k, True).many = True
        else:
            out.append(k)
    for p in (2, 3):
        i = 0
        while i + 2 * p <= len(out):
            if [k.sig for k in out[i : i + p]] != [k.sig for k in out[i + p : i + 2 * p]]:
                i += 1
                continue
            group = Block("(" + " ".join(k.sig for k in out[i : i + p]) + ")", out[i : i + p], many=True)
            j = i + p
            while [k.sig for k in out[j : j + p]] == [k.sig for k in group.kids]:
                join(group, Block(group.sig, out[j : j + p]), True)
                j += p
            out[i:j] = [group]
            i += 1
    return out


def grouped(kids: list[Block], other: list[Block]) -> list[Block]:
    """Puts runs of ``kids`` that are a group on the other side into such a group."""
    for g in other:
        if g.sig.startswith("(") and all(k.sig != g.sig for k in kids):
            parts = [k.sig for k in g.kids]
            for i in range(len(kids) - len(parts) + 1):
                if [k.sig for k in kids[i : i + len(parts)]] == parts:
                    kids = [*kids[:i], Block(g.sig, kids[i : i + len(parts)], pages=max(k.pages for k in kids[i : i + len(parts)])), *kids[i + len(parts) :]]
                    break
    return kids


def common(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places of a common subsequence of two signature sequences, the longest up to ``CELLS``.

    Equal ends are matched first.  Of long sequences, signatures that are unique in both are
    matched in order, and what lies between them likewise; without such, each takes the next equal one.
    """
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i, n, j, m = todo.pop()
        while i < n and j < m and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < n and j < m and a[n - 1] == b[m - 1]:
            n, m = n - 1, m - 1
            out.append((n, m))
        if i == n or j == m:
            continue
        if (n - i) * (m - j) <= CELLS:
            best = [[0] * (m - j + 1) for _ in range(n - i + 1)]
            for x in range(n - 1, i - 1, -1):
                row, under = best[x - i], best[x - i + 1]
                for y in range(m - 1, j - 1, -1):
                    row[y - j] = under[y - j + 1] + 1 if a[x] == b[y] else max(under[y - j], row[y - j + 1])
            x, y = i, j
            while x < n and y < m:
                if a[x] == b[y]:
                    out.append((x, y))
                    x, y = x + 1, y + 1
                elif best[x - i + 1][y - j] >= best[x - i][y - j + 1]:
                    x += 1
                else:
                    y += 1
            continue
        ours, theirs = Counter(a[i:n]), Counter(b[j:m])
        place = {b[y]: y for y in range(j, m) if theirs[b[y]] == 1}
        anchors = ascending([(x, place[a[x]]) for x in range(i, n) if ours[a[x]] == 1 and a[x] in place])
        if anchors:
            out += anchors
            ends = [(i - 1, j - 1), *anchors, (n, m)]
            todo += [(x + 1, u, y + 1, v) for (x, y), (u, v) in zip(ends, ends[1:], strict=False)]
            continue
        places: dict[str, list[int]] = {}
        for y in range(j, m):
            places.setdefault(b[y], []).append(y)
        at = j
        for x in range(i, n):
            ys = places.get(a[x], ())
            k = bisect_left(ys, at)
            if k < len(ys):
                out.append((x, ys[k]))
                at = ys[k] + 1
    return sorted(out)


def ascending(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A longest part of ``pairs``, which ascend in the first place, that ascends in the second too."""
    tails, last, before = [], [], []
    for k, (_, y) in enumerate(pairs):
        at = bisect_left(tails, y)
        before.append(last[at - 1] if at else -1)
        tails[at : at + 1], last[at : at + 1] = [y], [k]
    out, k = [], last[-1] if last else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def align(a: list[Block], b: list[Block]) -> tuple[list[Block], list[tuple[Block, Block]]]:
    """The union-free merge of two child sequences, and the pairs of it that are to be joined."""
    if [k.sig for k in a] == [k.sig for k in b]:
        return a, list(zip(a, b, strict=True))
    a, b = grouped(a, b), grouped(b, a)
    out, pairs, i, j = [], [], 0, 0
    for x, y in [*common([k.sig for k in a], [k.sig for k in b]), (len(a), len(b))]:
        out += [*a[i:x], *b[j:y], *a[x : x + 1]]
        if x < len(a):
            pairs.append((a[x], b[y]))
        i, j = x + 1, y + 1
    return out, pairs


def pruned(root: Block) -> Block:
    """A wrapper of over ``NODES`` blocks without those on fewer than one in ``RARE`` of its pages.

    Pages judge such blocks by themselves, with the same rules but for the one on words that
    nearly all pages share, which no rare block meets.
    """
    blocks = root.below()
    if len(blocks) > NODES:
        for b in blocks:
            b.kids = [k for k in b.kids if RARE * k.pages >= root.pages]
    return root


def tag_of(b: Block) -> str:
    return b.sig.split(".")[0]


def noisy(b: Block, inside: bool) -> bool:
    """Whether a measured block's tag or names mark it as no article text."""
    tag, names = tag_of(b), b.sig.split(".")[1:]
    if tag in NOISE_TAGS:
        return True
    if tag in ("html", "body", "main", "article", "#") or b.sig.startswith("(") or b.has and not inside:
        return False
    words = {w.lower() for n in names for w in WORDS.findall(n)}
    return bool(words & NOISE_WORDS) or (tag == "header" or "header" in words or "masthead" in words) and not inside


def measure(root: Block) -> None:
    """Fills ``has`` (an article, main or h1 is in the block) and ``sums``.

    ``sums`` are the characters and those of links in the block without noisy parts, seen
    from outside and from inside an article.
    """
    for b in reversed(root.below()):
        tag = tag_of(b)
        b.has = tag in ("main", "article", "h1") or any(k.has for k in b.kids)
        own = (b.chars, b.links) if b.sig == "#" else (0, 0)
        views = []
        for inside in (False, True):
            kids = [k.sums[inside or tag in ("main", "article")] for k in b.kids]
            views.append((0, 0) if noisy(b, inside) else (own[0] + sum(k[0] for k in kids), own[1] + sum(k[1] for k in kids)))
        b.sums = tuple(views)


def regions(root: Block) -> list[Block]:
    """The outermost ``main`` blocks of a measured tree, or its outermost ``article`` blocks."""
    for tag in ("main", "article"):
        found, todo = [], [root]
        while todo:
            b = todo.pop()
            named = tag_of(b) == tag or tag == "main" and ".main" in b.sig.split(" ")[0] and tag_of(b) != "body"
            if noisy(b, False):
                continue
            if named:
                found.append(b)
            else:
                todo.extend(reversed(b.kids))
        if found:
            return found
    return []


def densest(root: Block) -> Block:
    """The innermost block that holds nearly all text of a measured tree without ``main`` or ``article``."""
    at = root
    while True:
        whole = at.sums[0][0]
        inner = next((k for k in at.kids if k.sig != "#" and not noisy(k, False) and k.sums[0][0] >= 0.8 * whole > 0), None)
        if inner is None or inner.many:
            return at
        at = inner


def link_list(b: Block) -> bool:
    chars, links = b.sums[1]
    return tag_of(b) in ("ul", "ol", "div", "table") and chars > 0 and links > 0.7 * chars and any(k.many for k in b.kids)


def mark(region: Block) -> set[int]:
    """Identities of the text slots of a measured region that belong to the article."""
    slots, todo = [], [region]
    while todo:
        b = todo.pop()
        if b is not region and (noisy(b, True) or link_list(b)):
            continue
        if b.sig == "#":
            slots.append(b)
        todo.extend(reversed(b.kids))
    varied = any(s.text == 0 for s in slots)
    constant = lambda s: varied and s.text and not s.many and region.pages >= 5 and s.pages >= 0.8 * region.pages
    return {id(s) for s in slots if not constant(s)}  # the same words on nearly all pages belong to the template


class Wrapper:
    """A host's wrapper with what its regions keep, found when a page asks."""

    def __init__(self, root: Block):
        self.root, self.kept = root, {}
        measure(root)
        self.densest = None if regions(root) else densest(root)

    def slots(self, region: Block) -> set[int]:
        if id(region) not in self.kept:
            self.kept[id(region)] = mark(region)
        return self.kept[id(region)]


def matched(page: Block, wrapper: Block) -> dict[int, Block]:
    """The wrapper's block for each of the page's blocks that it has, by identity."""
    found, todo = {}, [(page, wrapper)]
    while todo:
        a, w = todo.pop()
        found[id(a)] = w
        a.kids = grouped(a.kids, w.kids)
        todo += [(a.kids[i], w.kids[j]) for i, j in common([k.sig for k in a.kids], [k.sig for k in w.kids])]
    return found


def choose(page: Block, wrapper: Wrapper) -> tuple[list[bool], bool]:
    """For the text slots of the page, in order, whether they are article text; and whether the page's shape alone decided.

    The region is the page's own: of its ``main`` or ``article`` blocks the one that most
    pages have; without such, the wrapper's densest block if the host has none either, else
    the page's.  Inside, the wrapper's slots decide; blocks that it lacks are judged as they are.
    """
    pairs = matched(page, wrapper.root)
    measure(page)
    of = lambda b: pairs.get(id(b))
    own = regions(page)
    if own:
        region = max(own, key=lambda b: (of(b).pages, of(b).sums[1][0]) if of(b) else (0, b.sums[1][0]))
        certain = len(own) == 1 or all(of(b) for b in own)
    else:
        region, certain = next((b for b in page.below() if wrapper.densest is not None and of(b) is wrapper.densest), None), True
        if region is None:
            region, certain = densest(page), False
    if of(region) is None:
        kept = mark(region)
        return [id(s) in kept for s in slots_of(page)], False
    slots, kept, todo = wrapper.slots(of(region)), set(), [region]
    while todo:
        b = todo.pop()
        if of(b) is not None:
            if b.sig == "#" and id(of(b)) in slots:
                kept.add(id(b))
            todo.extend(b.kids)
        elif not noisy(b, True):
            certain = False
            if not link_list(b):
                kept.update([id(b)] if b.sig == "#" else [])
                todo.extend(b.kids)
    return [id(s) in kept for s in slots_of(page)], certain


def slots_of(b: Block) -> list[Block]:
    return [x for x in b.below() if x.sig == "#"]


def merged(packed: list[str]) -> str:
    """The wrapper of some layouts, merged in the order given."""
    whole = None
    for text in packed:
        one = Block.unpack(text)
        whole = one if whole is None else pruned(join(whole, one, False))
    return whole.pack()


def host_wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper): sums of equally built pages, then the layouts of a slot of the host, then its slots.

    Equally built pages add up whatever their order; layouts are merged in the order of
    their digests, so wrappers do not depend on how pages are dealt out.
    """

    def add(found: dict, key: tuple, root: Block) -> None:
        found[key] = join(found[key], root, False) if key in found else root

    def table(found: dict) -> dict[str, list]:
        return {"host": [h for h, _ in found], "layout": [x for _, x in found], "wrapper": [b.pack() for b in found.values()]}

    def infer(batches: Iterator[dict[str, list]]):
        found: dict[tuple, Block] = {}
        held = 0
        for b in batches:
            for host, page in zip(b["host"], b["html"], strict=True):
                root, _ = parse(page or "")
                for s in slots_of(root):
                    s.leaves = []
                key = host, hashlib.sha256(root.shape().encode("utf-8", "replace")).hexdigest()
                held += 0 if key in found else len(root.below())
                add(found, key, root)
                if held > 200_000:
                    yield table(found)
                    found, held = {}, 0
        yield table(found)

    def total(rows: pd.DataFrame) -> pd.DataFrame:
        first = rows.iloc[0]
        return pd.DataFrame({"host": [first["host"]], "layout": [first["layout"]], "wrapper": [merged(list(rows["wrapper"]))]})

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("layout")
        return pd.DataFrame({"host": [rows["host"].iloc[0]], "layout": [rows["layout"].iloc[0]], "wrapper": [merged(list(rows["wrapper"]))]})

    schema = "host string, layout string, wrapper string"
    parts = arrow_map(pages.select("host", "html"), schema, infer)
    layouts = parts.groupBy("host", "layout").applyInPandas(total, schema)
    slot = F.substring("layout", 1, 2)
    return layouts.groupBy("host", slot.alias("slot")).applyInPandas(merge, schema).groupBy("host").applyInPandas(merge, schema).drop("layout")


def extract_pages(pages: DataFrame, broadcast_bytes: int = 32 << 20) -> DataFrame:
    """The article text of web pages, by a wrapper inferred for each host.

    pages(page_id, url, html). Pages of a host are aligned block by block: equal blocks
    join, mismatches become optional or repeated groups, texts that differ become slots.
    The wrapper's slots in the page's main region, outside blocks that are menus, headers,
    footers, sidebars, notices, adverts, forms, link lists or reader comments, and not the same on
    nearly all pages with that region, are the article. Pages of one host may have regions of
    their own; what the wrapper lacks is judged by the page alone.

    Returns per page row: page_id, url, text (blocks in page order joined by one space,
    character references decoded; empty if none), blocks (array of the texts).

    Null or empty html: empty text. A null url or one without a host shares the wrapper of
    the host ''. Repeated rows give repeated rows, an empty table an empty one; other
    columns are ignored. Wrappers are broadcast while all together take at most
    ``broadcast_bytes``; beyond, pages are joined with them by host.
    """
    given = split_link(pages.select("page_id", "url", "html")).select("page_id", "url", "html", "host")
    wrappers = written(host_wrappers(given), "wrappers")
    kind = pages.schema["page_id"].dataType.simpleString()
    size = wrappers.agg(F.sum(F.length("wrapper"))).first()[0] or 0
    shared = None
    if size <= broadcast_bytes:
        shared = pages.sparkSession.sparkContext.broadcast({r.host: r.wrapper for r in wrappers.collect()})
    else:
        given = given.join(wrappers, "host", "left")

    def step(batches: Iterator[dict[str, list]]):
        known: dict[str, tuple] = {}
        for b in batches:
            out = {"page_id": b["page_id"], "url": b["url"], "text": [], "blocks": []}
            for k, (host, page) in enumerate(zip(b["host"], b["html"], strict=True)):
                if host not in known:
                    if len(known) > 2_000:
                        known.clear()
                    known[host] = (Wrapper(Block.unpack(shared.value[host] if shared else b["wrapper"][k])), {})
                wrapper, seen = known[host]
                tree, texts = parse(page or "")
                shape = tree.shape()
                chosen = seen.get(shape)
                if chosen is None:
                    chosen, certain = choose(tree, wrapper)
                    if len(seen) > 2_000:
                        seen.clear()
                    if certain:
                        seen[shape] = chosen
                ours = sorted(leaf for s, ok in zip(slots_of(tree), chosen, strict=True) if ok for leaf in s.leaves)
                blocks = [texts[i] for i in ours]
                out["text"].append(" ".join(blocks))
                out["blocks"].append(blocks)
            yield out

    return arrow_map(given, f"page_id {kind}, url string, text string, blocks array<string>", step)
