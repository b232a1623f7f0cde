"""MinHash near-dedup with an LSH forest: sorted signature orders, neighbours by common prefix, depth by region."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, blank_words, discard, raw_text, written
from .components import components

TREES, DEPTH, LEAST_DEPTH = 16, 8, 4  # sorted orders, hashes in each, hashes that make a region
WINDOW, STRONG = 1_024, 32  # rows on that the scan looks for a row's nearest and strongest candidate
EDGE = 64  # rows at an end of a range that are scanned with the next range
NEAREST = 4  # candidates a text that are confirmed one by one; the others meet in tiles
TILE = 192
BITS = 100  # of 128 sketch bits that must agree: at similarity 0.8 115 do, with a deviation of 3.4
MIX = np.uint64(0x9E3779B97F4A7C15)
WORDS = 300_000  # word hashes that a task keeps at a time


class Shingler:
    """64-bit hashes of the distinct shingles of a text."""

    def __init__(self, words: int):
        self.words, self.known = words, {}

    def shingles(self, raw: bytes | None) -> np.ndarray:
        words = blank_words(raw)
        if not words:
            return np.zeros(0, np.uint64)
        known = self.known
        if len(known) > WORDS:
            known.clear()
        codes = []
        for w in words:
            h = known.get(w)
            if h is None:
                h = known[w] = xxhash.xxh3_64_intdigest(w)
            codes.append(h)
        h = np.array(codes, np.uint64)
        n = min(self.words, len(words))
        out = h[: len(h) - n + 1].copy()
        for k in range(1, n):
            out = (out ^ (out >> np.uint64(29))) * MIX + h[k : len(h) - n + 1 + k]
        out = (out ^ (out >> np.uint64(31))) * MIX
        return np.unique(out ^ (out >> np.uint64(30)))


def permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240607)
    return rng.integers(0, 1 << 31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, n, dtype=np.uint32)


def signature(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least value of each permutation, the set taken in slices."""
    least = np.full(len(a), 0xFFFFFFFF, np.uint32)
    low = (shingles >> np.uint64(32)).astype(np.uint32)
    for cut in range(0, len(low), 2048):
        least = np.minimum(least, (low[cut : cut + 2048, None] * a + b).min(0))
    return least


def sketches(segments: DataFrame, words: int) -> DataFrame:
    """(segment_id, row_no, text, n_shingles, digest, signature, bits1, bits2); digest null for empty sets."""
    kind = segments.schema["segment_id"].dataType.simpleString()

    def step(batches: Iterator[dict[str, list]]):
        make, at = Shingler(words), TaskContext.get().partitionId() << 33
        a, b = permutations(TREES * DEPTH)
        for batch in batches:
            for cut in range(0, len(batch["raw"]), 512):
                out = {k: [] for k in ("segment_id", "row_no", "text", "n_shingles", "digest", "signature", "bits1", "bits2")}
                for key, raw in zip(batch["segment_id"][cut : cut + 512], batch["raw"][cut : cut + 512], strict=True):
                    s = make.shingles(raw)
                    sig = signature(s, a, b) if len(s) else None
                    # one bit of each least value, mixed so that it is fair
                    bits = np.packbits(((sig * np.uint32(0x85EBCA6B)) >> np.uint32(31)).astype(np.uint8)).view(np.int64) if len(s) else (None, None)
                    row = (key, at, raw, len(s), xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None, sig.astype(">u4").tobytes() if len(s) else None,
                           None if bits[0] is None else int(bits[0]), None if bits[1] is None else int(bits[1]))
                    for k, v in zip(out, row, strict=True):
                        out[k].append(v)
                    at += 1
                yield out

    schema = f"segment_id {kind}, row_no bigint, text binary, n_shingles bigint, digest binary, signature binary, bits1 bigint, bits2 bigint"
    return arrow_map(segments.select("segment_id", raw_text("text").alias("raw")), schema, step)


def forest(nodes: DataFrame) -> DataFrame:
    """Each distinct set once a tree: (node, n, bits1, bits2, tree, prefix)."""
    return nodes.select("node", "n", "bits1", "bits2", "signature", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree")).select(
        "node", "n", "bits1", "bits2", "tree", F.expr(f"substring(signature, tree * {DEPTH * 4} + 1, {DEPTH * 4})").alias("prefix"),
    )


def scan(rows: list[np.ndarray], fresh: int, similarity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places i, j and agreeing bits: each row's nearest and strongest agreeing rows behind it in its region.

    ``rows`` are tree, region, node, n, bits1, bits2 in sorted order; rows before ``fresh``
    were met before, and only pairs with a later row are looked for. The nearest is
    looked for up to ``WINDOW`` rows on, the strongest up to ``STRONG``.
    """
    tree, region, _, n, one, two = rows
    alive = np.arange(len(tree))  # rows whose region reaches on
    near, strong = np.full(len(tree), -1, np.int64), np.full(len(tree), -1, np.int64)
    bits = np.zeros(len(tree), np.int64)
    first = np.zeros(len(tree), np.int64)
    for o in range(1, WINDOW + 1):
        alive = alive[alive + o < len(tree)]
        alive = alive[(tree[alive] == tree[alive + o]) & (region[alive] == region[alive + o])]
        if o > STRONG:
            alive = alive[near[alive] < 0]
        if not len(alive):
            break
        i = alive[alive + o >= fresh]
        j = i + o
        same = 128 - np.bitwise_count((one[i] ^ one[j]).view(np.uint64)).astype(np.int64) - np.bitwise_count((two[i] ^ two[j]).view(np.uint64))
        good = (same >= BITS) & (100 * np.minimum(n[i], n[j]) >= similarity * np.maximum(n[i], n[j]))
        i, j, same = i[good], j[good], same[good]
        new = near[i] < 0
        near[i[new]], first[i[new]] = j[new], same[new]
        more = same > bits[i]
        strong[i[more]], bits[i[more]] = j[more], same[more]
    i = np.concatenate([np.flatnonzero(near >= 0), np.flatnonzero((strong >= 0) & (strong != near))])
    cut = int((near >= 0).sum())
    return i, np.concatenate([near[i[:cut]], strong[i[cut:]]]), np.concatenate([first[i[:cut]], bits[i[cut:]]])


ROW = ["tree", "prefix", "node", "n", "bits1", "bits2"]


def arrays(b: dict[str, list]) -> list[np.ndarray]:
    prefix = np.frombuffer(b"".join(b["prefix"]), np.uint8).reshape(-1, DEPTH * 4)[:, : LEAST_DEPTH * 4]
    region = np.ascontiguousarray(prefix).view(f"V{LEAST_DEPTH * 4}").ravel()
    return [np.array(b["tree"], np.int64), region, *(np.array(b[k], np.int64) for k in ROW[2:])]


def found_pairs(rows: list[np.ndarray], fresh: int, similarity: int) -> dict[str, list]:
    i, j, agree = scan(rows, fresh, similarity)
    node = rows[2]
    return {"a": np.minimum(node[i], node[j]).tolist(), "b": np.maximum(node[i], node[j]).tolist(), "agree": agree.tolist()}


def neighbours(rows: DataFrame, similarity: int) -> DataFrame:
    """(a, b, agree): candidates from the sorted order of each tree.

    The order is dealt out by ranges that may cut a region anywhere; the rows at both
    ends of each range are scanned again with those of the next.
    """
    partitions = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = rows.repartitionByRange(partitions, "tree", "prefix", "node").sortWithinPartitions("tree", "prefix", "node")

    def step(batches: Iterator[dict[str, list]]):
        held, head, part = None, None, TaskContext.get().partitionId()
        empty = {k: [] for k in ("a", "b", "agree", "seam", *ROW)}

        def edge(some: dict[str, list], seam: int):
            k = len(some["node"])
            return {**empty, **{c: [None] * k for c in ("a", "b", "agree")}, "seam": [seam] * k, **some}

        tail: dict[str, list] = {k: [] for k in ROW}
        for b in batches:
            if not b["node"]:
                continue
            now, fresh = arrays(b), 0
            if held is not None:
                fresh = len(held[0])
                now = [np.concatenate(x) for x in zip(held, now, strict=True)]
            held = [x[-WINDOW:] for x in now]
            if head is None:
                head = {k: b[k][:EDGE] for k in ROW}
                yield edge(head, part - 1)
            tail = {k: (tail[k] + b[k])[-EDGE:] for k in ROW}
            out = found_pairs(now, fresh, similarity)
            yield {**out, **{c: [None] * len(out["a"]) for c in ("seam", *ROW)}}
        yield edge(tail, part)

    schema = "a bigint, b bigint, agree bigint, seam int, tree int, prefix binary, node bigint, n bigint, bits1 bigint, bits2 bigint"
    met = written(arrow_map(ordered.select(*ROW), schema, step), "met")

    def seams(table: pa.Table) -> pa.Table:
        rows = sorted(table.select(ROW).to_pylist(), key=lambda r: (r["tree"], r["prefix"], r["node"]))
        out = found_pairs(arrays({k: [r[k] for r in rows] for k in ROW}), 0, similarity)
        return pa.table({k: pa.array(v, pa.int64()) for k, v in out.items()})

    across = met.where("seam IS NOT NULL").select("seam", *ROW).groupBy("seam").applyInArrow(seams, "a bigint, b bigint, agree bigint")
    out = written(met.where("a IS NOT NULL").select("a", "b", "agree").unionByName(across).groupBy("a", "b").agg(F.max("agree").alias("agree")), "candidates")
    discard(met)
    return out


def confirmed(pairs: DataFrame, texts: DataFrame, words: int, similarity: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough."""

    def step(batches: Iterator[dict[str, list]]):
        make = Shingler(words)
        kept: dict[int, np.ndarray] = {}

        def of(node: int, raw: bytes) -> np.ndarray:
            if node not in kept:
                if len(kept) > 500:
                    kept.clear()
                kept[node] = make.shingles(raw)
            return kept[node]

        for b in batches:
            out = {"a": [], "b": []}
            for x, y, p, q in zip(b["a"], b["b"], b["text_a"], b["text_b"], strict=True):
                s, t = of(x, p), of(y, q)
                both = len(np.intersect1d(s, t, assume_unique=True))
                if 100 * both >= similarity * (len(s) + len(t) - both):
                    out["a"].append(x)
                    out["b"].append(y)
            yield out

    left, right = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    return arrow_map(pairs.select("a", "b").join(left, "a").join(right, "b"), "a bigint, b bigint", step)


def shared_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, by products of membership tables in slices of the hashes."""
    every = np.unique(np.concatenate([*left, *right]))
    out = np.zeros((len(left), len(right)), np.float32)
    for cut in range(0, len(every), 8_192):
        part = every[cut : cut + 8_192]
        tables = []
        for sets in (left, right):
            table = np.zeros((len(sets), len(part)), np.float32)
            for k, s in enumerate(sets):
                table[k, np.searchsorted(part, s[(s >= part[0]) & (s <= part[-1])])] = 1
            tables.append(table)
        out += tables[0] @ tables[1].T
    return out.astype(np.int64)


def rest_links(candidates: DataFrame, roots: DataFrame, texts: DataFrame, words: int, similarity: int) -> DataFrame:
    """Links across the components that are left inside a cluster of candidates.

    A cluster is a connected set of candidate pairs, confirmed or not. Where it holds
    several components, all members outside the largest are compared with all members,
    on full sets, in tiles of about ``TILE`` by ``TILE`` texts: a pair of tiles is a task's work,
    no pair is a row, and a member gives one link to each other component at most.
    """
    loose = components(candidates)
    clusters = loose.select("node", F.col("root").alias("cluster")).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    clusters = written(clusters, "clusters")
    discard(loose)
    by = clusters.groupBy("cluster", "root").agg(F.count("*").alias("k"))
    mixed = by.groupBy("cluster").agg(F.max(F.struct("k", "root")).alias("top"), F.sum("k").alias("members"), F.count("*").alias("kinds")).where("kinds > 1")
    some = clusters.join(mixed.select("cluster", F.col("top.root").alias("main"), "members", (F.col("members") - F.col("top.k")).alias("minors")), "cluster")
    tiles = lambda c: F.ceil(F.col(c) / TILE).cast("int")
    place = lambda c: F.pmod(F.xxhash64("node"), tiles(c)).cast("int")
    row = ["cluster", "node", "root"]
    spread = lambda c: F.explode(F.sequence(F.lit(0), tiles(c) - 1))
    asked = some.where("root != main").select(*row, F.lit(True).alias("asks"), place("minors").alias("x"), spread("members").alias("y"))
    against = some.select(*row, F.lit(False).alias("asks"), spread("minors").alias("x"), place("members").alias("y"))
    placed = asked.unionByName(against).join(texts, "node")

    def compare(table: pa.Table) -> pa.Table:
        asks = np.array(table["asks"].to_pylist(), bool)
        make, out = Shingler(words), {"a": [], "b": []}
        nodes, root = np.array(table["node"].to_pylist(), np.int64), np.array(table["root"].to_pylist(), np.int64)
        sets = [make.shingles(t) for t in table["text"].to_pylist()]
        i, j = np.flatnonzero(asks), np.flatnonzero(~asks)
        if len(i) and len(j):
            both = shared_counts([sets[k] for k in i], [sets[k] for k in j])
            size = np.array([len(x) for x in sets], np.int64)
            linked = (100 * both >= similarity * (size[i][:, None] + size[j][None, :] - both)) & (root[i][:, None] != root[j][None, :])
            for k in np.flatnonzero(linked.any(1)):
                there = j[linked[k]]
                _, one = np.unique(root[there], return_index=True)
                out["a"] += [int(nodes[i[k]])] * len(one)
                out["b"] += nodes[there[one]].tolist()
        return pa.table({k: pa.array(v, pa.int64()) for k, v in out.items()})

    out = written(placed.groupBy("cluster", "x", "y").applyInArrow(compare, "a bigint, b bigint"), "links")
    discard(clusters)
    return out


def find_near_copies(segments: DataFrame, words: int = 5, similarity: int = 80) -> DataFrame:
    """Groups narration segments whose word shingles are nearly the same.

    segments(segment_id, text). A text's set holds its distinct shingles of ``words`` words
    (A-Z lower-cased, split at blanks); a text of fewer words is one shingle. Texts are
    linked if 100 * intersection >= ``similarity`` * union; groups are connected
    components.

    Equal sets are one node. Each node stands in ``TREES`` orders sorted by signature; rows
    that share ``LEAST_DEPTH`` hashes are a region, and within it neighbours by longer
    common prefix come first, so that a dense region is searched deeper. Each row's nearest
    and strongest neighbours that agree by sketch are candidates. The strongest are
    confirmed on the full sets; then, in each cluster of candidates that holds several
    components, all members outside the largest are compared with all others. At
    similarity 0.8 two texts share a region with probability 0.9998.

    Returns per segment row: segment_id, n_shingles, component_id (smallest segment_id of
    its group), kept (it is that segment).

    Null, empty or blank text: no shingle, a group of its own. Rows that repeat a
    segment_id are nodes of their own and share its id; ties do not matter. An empty table
    gives an empty one; other columns are ignored.
    """
    made = written(sketches(segments, words), "sketches", compression="zstd")
    full = made.where("digest IS NOT NULL")
    nodes = full.groupBy("digest").agg(F.min("row_no").alias("node"), F.min("segment_id").alias("least_id"), F.first("n_shingles").alias("n"),
                                       F.first("bits1").alias("bits1"), F.first("bits2").alias("bits2"), F.first("signature").alias("signature"))
    nodes = written(nodes, "nodes")
    found = neighbours(forest(nodes), similarity)
    near = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("agree"), "b"))
    tried = found.withColumn("k", near).where(F.col("k") <= NEAREST).select("a", "b")
    texts = made.select(F.col("row_no").alias("node"), "text")
    links = written(confirmed(tried, texts, words, similarity), "links")
    roots = components(links)
    more = rest_links(found, roots, texts, words, similarity)
    if more.head(1):
        last, roots = roots, components(more.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))))
        discard(last)
    grouped = nodes.join(roots, "node", "left").select("digest", F.coalesce("root", "node").alias("root"), "least_id")
    least = grouped.groupBy("root").agg(F.min("least_id").alias("component_id"))
    class_of = grouped.join(least, "root").select("digest", "component_id")
    out = written(made.select("segment_id", "n_shingles", "digest").join(class_of, "digest", "left").select(
        "segment_id", "n_shingles", F.coalesce("component_id", "segment_id").alias("component_id"),
        F.col("segment_id").eqNullSafe(F.coalesce("component_id", "segment_id")).alias("kept"),
    ), "copies")
    discard(made, nodes, found, links, more, roots)
    return out
