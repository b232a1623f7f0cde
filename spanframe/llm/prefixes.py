"""The prefix tree of cue sequences: which sources start alike, and what their shared starts save.

A source's cues are laid on positional columns, ``WIDTH`` to a block.  One SQL ROLLUP over
those columns gives every prefix of every block at once; ``grouping_id`` tells how deep it
is.  A source with more cues goes on in further rows, keyed by the node that its blocks
before lead to, so the number of blocks costs no rounds.

Node keys are digests: a cue is the SHA-256 of its framed speaker and text; the node before
a block is the exact sum, limb by limb, of the SHA-256 digests of the blocks before it.
Such a sum is a running sum, so a source of any length is cut over many tasks.

Sums over subtrees need no walk over the tree.  A node belongs to its smallest source; of a
source's path the nodes it owns are the tail.  A subtree's saved words are then, over the
sources in it, the words before that tail, and its leaves the sources that own a childless
node: both are sums over the same ROLLUP.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.ordered import by_rows, positions, scan
from .common import arrow_map, discard, written

WIDTH = 8  # positional columns of a block
LIMBS = 8  # 32-bit parts of a digest that are summed apart
STRETCH = 1_024  # blocks of a source that meet their source's row in one task
SPREAD = 64  # slots over which the children of one node meet their parent
CHUNK = 65_536  # bytes of joined ids that a node gets at once


def cue_ids(cues: DataFrame) -> DataFrame:
    """source_id, ord, id of every cue that has a source: the digest of speaker and text, then its words.

    Null speakers and texts are empty ones.  Words are runs of ``[^\\x20\\x09-\\x0D]``.
    """
    speaker, text = F.coalesce(F.col("speaker").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    framed = F.concat(F.octet_length(speaker).cast("string"), F.lit(":"), speaker, text)
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    cue = F.concat(F.unhex(F.sha2(framed.cast("binary"), 256)), F.unhex(F.lpad(F.hex(words), 16, "0")))
    return cues.where("source_id IS NOT NULL").select("source_id", F.col("ord").cast("long").alias("ord"), cue.alias("id"))


def numbered(ids: DataFrame) -> DataFrame:
    """Cue ids with their place in the source: by ord, null first, ties by id."""
    block = F.coalesce(by_rows("ord"), F.lit(-(2**62)).cast("long"))
    return positions(ids, ["source_id"], ["ord", "id"], block, "pos")


def words_of(cue: Column) -> Column:
    return F.coalesce(F.conv(F.hex(F.substring(cue, 33, 8)), 16, 10).cast("long"), F.lit(0).cast("long"))


def laid(ids: DataFrame, sources: DataFrame) -> DataFrame:
    """One row per source and block: its cues t1.., the node before it, the node after it, the words before it."""
    columns = [f"t{k}" for k in range(1, WIDTH + 1)]
    turns = numbered(ids).select("source_id", F.expr(f"(pos - 1) div {WIDTH}").alias("block"), ((F.col("pos") - 1) % WIDTH).alias("place"), "id")
    every = sources.where("source_id IS NOT NULL").select("source_id").distinct()
    turns = turns.unionByName(every.select("source_id", F.lit(0).cast("long").alias("block"), F.lit(None).cast("long").alias("place"), F.lit(None).cast("binary").alias("id")))
    wide = turns.groupBy("source_id", "block").agg(*[F.max(F.when(F.col("place") == k, F.col("id"))).alias(f"t{k + 1}") for k in range(WIDTH)])
    digest = F.sha2(F.concat_ws("/", F.col("block").cast("string"), *[F.hex(c) for c in columns]), 256)
    words = sum((words_of(F.col(c)) for c in columns), F.lit(0).cast("long"))
    wide = wide.withColumn("digest", digest).withColumn("words", words)
    limbs = {f"l{k}": F.conv(F.substring("digest", 8 * k + 1, 8), 16, 10).cast("long") for k in range(LIMBS)}
    wide = wide.select("*", *[v.alias(f"own_{n}") for n, v in limbs.items()])
    sums = {n: F.col(f"own_{n}") for n in limbs} | {"upto": F.col("words")}
    run = scan(wide, ["source_id"], ["block"], by_rows("block"), sums=sums)
    node = lambda parts, at: F.sha2(F.concat_ws(",", at.cast("string"), *[p.cast("string") for p in parts]), 256)
    return run.select(
        "source_id", "block", *columns,
        node([F.col(n) - F.col(f"own_{n}") for n in limbs], F.col("block")).alias("key"),
        node([F.col(n) for n in limbs], F.col("block") + 1).alias("next_key"),
        (F.col("upto") - F.col("words")).alias("before"), "upto",
    )


def rolled(rows: DataFrame, sums: str) -> DataFrame:
    """All prefixes of all blocks: node, parent, depth in the block (level) and the aggregates ``sums``."""
    columns = ", ".join(f"t{k}" for k in range(1, WIDTH + 1))
    found = rows.sparkSession.sql(
        f"SELECT block, key, {columns}, {WIDTH} - bit_count(grouping_id()) AS level, max(next_key) AS next_key, {sums} FROM {{rows}} GROUP BY block, key, ROLLUP({columns})",
        rows=rows,
    )
    at = F.array(*[F.col(f"t{k}") for k in range(1, WIDTH + 1)])
    found = found.where((F.col("level") > 0) & F.get(at, F.col("level") - 1).isNotNull() | (F.col("level") == 0) & (F.col("block") == 0))
    path = lambda less: F.sha2(F.concat_ws("/", "key", *[F.when(F.col("level") - less >= k, F.hex(f"t{k}")) for k in range(1, WIDTH + 1)]), 256)
    node = F.when(F.col("level") == WIDTH, F.col("next_key")).when(F.col("level") == 0, F.col("key")).otherwise(path(0))
    parent = F.when(F.col("level") == 1, F.col("key")).when(F.col("level") > 1, path(1))
    return found.withColumn("node", node).withColumn("parent", parent)


def ends_digest(ends: DataFrame) -> DataFrame:
    """SHA-256 of the ids that end at each node, ascending, comma-joined.

    Ids are joined in ranges, so that a node where many end gets them in pieces of
    ``CHUNK`` bytes; only the digest itself, which has an order, runs in one task.
    """

    def join(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        at, first, parts, size = None, None, [], 0
        for batch in batches:
            out = []
            for node, key in zip(batch["node"], batch["source_id"], strict=True):
                text = str(key)
                if parts and (node != at or size >= CHUNK):
                    out.append((at, first, ",".join(parts)))
                    parts, size = [], 0
                if not parts:
                    at, first = node, key
                parts.append(text)
                size += len(text) + 1
            if out:
                yield dict(zip(["node", "first", "ids"], map(list, zip(*out, strict=True)), strict=True))
        if parts:
            yield {"node": [at], "first": [first], "ids": [",".join(parts)]}

    def digest(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        at, state = None, None
        for batch in batches:
            out = []
            for node, ids in zip(batch["node"], batch["ids"], strict=True):
                if node != at:
                    if state is not None:
                        out.append((at, state.hexdigest()))
                    at, state = node, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.encode())
            if out:
                yield dict(zip(["node", "ends_sha256"], map(list, zip(*out, strict=True)), strict=True))
        if state is not None:
            yield {"node": [at], "ends_sha256": [state.hexdigest()]}

    kind = next(f.dataType for f in ends.schema if f.name == "source_id").simpleString()
    pieces = arrow_map(ends.repartitionByRange("node", "source_id").sortWithinPartitions("node", "source_id"), f"node string, first {kind}, ids string", join)
    return arrow_map(pieces.repartition("node").sortWithinPartitions("node", "first").select("node", "ids"), "node string, ends_sha256 string", digest)


def with_parents(nodes: DataFrame) -> DataFrame:
    """Nodes with their parent's source: each parent is sent to the slots that its children are dealt over."""
    slot = F.pmod(F.xxhash64("node"), F.lit(SPREAD)).cast("int")
    children = nodes.withColumn("slot", slot)
    asked = children.where("parent IS NOT NULL").select("parent", "slot").distinct()
    known = asked.join(nodes.select(F.col("node").alias("parent"), F.col("source_id").alias("parent_source_id")), "parent")
    return children.join(known, ["parent", "slot"], "left").drop("slot")


def prefix_tree(ids: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """The tree of ``cue_tree`` over cue ids (source_id, ord, id as ``cue_ids`` makes them)."""
    rows = written(laid(ids, ids if sources is None else sources), "prefix-rows")
    first = rolled(rows, "count(*) AS n_sources, min(source_id) AS source_id, max(before) AS before")
    earlier = F.col("before") + sum((F.when(F.col("level") > k, words_of(F.col(f"t{k}"))).otherwise(0) for k in range(1, WIDTH + 1)), F.lit(0))
    nodes = written(first.select("node", "parent", (F.col("block") * WIDTH + F.col("level")).alias("depth"), "source_id", "n_sources", earlier.cast("long").alias("before")), "prefix-nodes")
    children = nodes.where("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    counted = written(nodes.join(children, "node", "left").fillna(0, ["n_children"]), "prefix-counts")

    # of each source: the words before the nodes it owns (all, if it owns none), and whether its last node is a leaf
    owned = counted.groupBy("source_id").agg(F.min("before").alias("saved"), F.max((F.col("n_children") == 0).cast("long")).alias("leaf"))
    wholes = rows.groupBy("source_id").agg(F.max("upto").alias("upto"), F.max("block").alias("last"))
    paths = wholes.join(owned, "source_id", "left").select(
        "source_id", "last", F.coalesce("saved", "upto").alias("saved"), F.coalesce("leaf", F.lit(0)).cast("long").alias("leaf"),
        F.explode(F.expr(f"sequence(0, last div {STRETCH})")).alias("stretch"),
    )
    told = written(rows.withColumn("stretch", F.expr(f"block div {STRETCH}")).join(paths, ["source_id", "stretch"]), "prefix-paths")

    past, still = F.col("before"), []
    for k in range(1, WIDTH + 1):
        still.append(F.greatest(F.col("saved") - past, F.lit(0)).cast("long").alias(f"s{k}"))
        past = past + words_of(F.col(f"t{k}"))
    second = rolled(told.select("*", *still), "sum(leaf) AS n_leaves, " + ", ".join(f"sum(s{k}) AS s{k}" for k in range(1, WIDTH + 1)))
    saved = F.get(F.array(*[F.col(f"s{k}") for k in range(1, WIDTH + 1)]), F.greatest(F.col("level") - 1, F.lit(0)))
    below = second.select("node", "n_leaves", saved.alias("saved_words"))

    held = sum((F.col(f"t{k}").isNotNull().cast("int") for k in range(1, WIDTH + 1)), F.lit(0))
    last = F.sha2(F.concat_ws("/", "key", *[F.hex(f"t{k}") for k in range(1, WIDTH + 1)]), 256)
    end = F.when(held == WIDTH, F.col("next_key")).when(held == 0, F.col("key")).otherwise(last)
    ends = ends_digest(told.where("block = last").select(end.alias("node"), "source_id"))
    tree = with_parents(counted).join(below, "node").join(ends, "node", "left").select(
        "source_id", "depth", "parent_source_id", "n_sources", "n_children", "n_leaves", "saved_words", F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )
    out = written(tree, "prefix-tree")
    discard(rows, nodes, counted, told)
    return out


def cue_tree(cues: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """The prefix tree of the sources' cue sequences.

    ``cues`` are the library's cues (source_id, ord, speaker, text); ``sources`` (source_id),
    if given, adds sources without cues.  Other columns are not read.  A node is a distinct
    sequence of first cues, by speaker and text; the root is the empty one.  One row per node:
    source_id (the smallest that starts with it), depth, parent_source_id (null at the root),
    n_sources, n_children, n_leaves (childless nodes in its subtree), saved_words (over its
    subtree, words of a node's last text times its sources but one), ends_sha256 (of the
    ids of sources that end there, ascending, comma-joined).

    Cues go by ord, null first; ties by a digest of speaker and text; repeated rows are cues of
    their own.  Null speakers and texts are empty.  Cues without source_id belong to no
    sequence.  Texts count whole.  Without sources there is no node.
    """
    return prefix_tree(cue_ids(cues), sources)
