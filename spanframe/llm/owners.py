"""Exact copies among cues: radix tries of whole texts, whose terminal nodes hold the owner.

Two texts are equal when they are the same bytes once every blank (``[\\x20\\x09-\\x0D]``)
is gone.  Each task first enters its rows into a trie of its own, so that the copies of
one text, however many, leave it as one head per flush.  Heads are dealt out by length and
content hash, and every task enters the full byte strings it gets into a trie; a terminal
node keeps the smallest owner.  A trie that outgrows its store gives up its largest
subtree: those strings go to the next round, dealt out by subtree too.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, raw_text, written

BLANKS = b" \t\n\v\f\r"
STORE = 48 << 20  # bytes of strings that a task's trie may hold
NODE = 200  # bytes that a node costs besides its label


class Node:
    """A trie node: the bytes on the edge to it, its children by first byte, its payload if a string ends here."""

    __slots__ = ("label", "children", "payload", "size", "gone")

    def __init__(self, label: bytes) -> None:
        self.label, self.children, self.payload, self.size, self.gone = label, {}, None, 0, None


def shared(a: bytes, b: bytes) -> int:
    """Length of the common prefix, by bisection on slices."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


class Trie:
    """A radix trie from byte strings to payloads."""

    def __init__(self) -> None:
        self.root = Node(b"")

    def place(self, text: bytes) -> Node:
        """The node of ``text``, made if new; a node with ``gone`` set stands for a subtree that was given up."""
        node, at, path = self.root, 0, [self.root]
        while at < len(text):
            child = node.children.get(text[at])
            if child is None:
                child = Node(text[at:])
                node.children[text[at]] = child
                at = len(text)
            elif text.startswith(child.label, at):
                at += len(child.label)
                if child.gone is not None:
                    return child
            else:
                k = shared(child.label, text[at : at + len(child.label)])
                fork = Node(child.label[:k])
                fork.size = child.size + NODE
                fork.children[child.label[k]] = child
                node.children[text[at]] = fork
                child.label = child.label[k:]
                for up in path:
                    up.size += NODE
                child, at = fork, at + k
            node = child
            path.append(node)
        if node.payload is None:
            for up in path:
                up.size += len(node.label) + NODE
        return node

    def largest(self) -> tuple[Node, bytes]:
        """The first node below which strings part, and the path to it: what is left when one branch goes."""
        node, path = self.root, []
        while node.payload is None and len(live := [c for c in node.children.values() if c.gone is None]) == 1:
            node = live[0]
            path.append(node.label)
        return node, b"".join(path)

    def prune(self, mark: bool) -> list[tuple[bytes, list]]:
        """Removes the largest subtree and returns its strings with their payloads.

        With ``mark`` a stub stays, so that later strings of the subtree follow the earlier
        ones.  The last string of a trie is never removed, so every round settles some.
        """
        node, path = self.largest()
        live = [c for c in node.children.values() if c.gone is None]
        if not live:
            return []
        child = max(live, key=lambda c: c.size)
        out = list(strings(child, path))
        self.lighten(node, path, child.size)
        if mark:
            stub = Node(child.label)
            stub.gone = hashlib.sha256(path + child.label).digest()[:8]
            node.children[child.label[0]] = stub
        else:
            del node.children[child.label[0]]
        return out

    def lighten(self, last: Node, path: bytes, size: int) -> None:
        node, at = self.root, 0
        node.size -= size
        while node is not last:
            node = node.children[path[at]]
            at += len(node.label)
            node.size -= size


def strings(node: Node, path: bytes) -> Iterator[tuple[bytes, list]]:
    """All strings below ``node``, which hangs at ``path``."""
    todo = [(node, path)]
    while todo:
        node, path = todo.pop()
        path += node.label
        if node.payload is not None:
            yield path, node.payload
        todo.extend((c, path) for c in node.children.values() if c.gone is None)


def before(a: tuple, b: tuple) -> bool:
    """Whether owner ``a`` = (points, id, row) comes before ``b``: more code points, then the smaller id, nulls last."""
    if a[0] != b[0]:
        return a[0] > b[0]
    if a[1] != b[1]:
        return b[1] is None or (a[1] is not None and a[1] < b[1])
    return a[2] < b[2]


def gather(batches: Iterator[dict[str, list]], store: int) -> Iterator[dict[str, list]]:
    """Rows of members, and one head per text and flush with its owner so far."""
    trie, names = Trie(), ["row_no", "node", "sha", "id", "points", "size", "length", "hash", "text"]

    def heads(found: list) -> dict[str, list]:
        rows = []
        for text, (node, sha, owner, size) in found:
            rows.append((owner[2], node, None, owner[1], owner[0], size, len(text), int.from_bytes(sha[:8], "little", signed=True), text))
        return dict(zip(names, [list(c) for c in zip(*rows, strict=True)], strict=True))

    for batch in batches:
        rows = []
        for row_no, key, raw, points in zip(batch["row_no"], batch["cue_id"], batch["raw"], batch["points"], strict=True):
            text = (raw or b"").translate(None, BLANKS)
            at, owner = trie.place(text), (points, key, row_no)
            if at.payload is None:
                at.payload = [row_no, hashlib.sha256(text).digest(), owner, 1]
            else:
                at.payload[3] += 1
                if before(owner, at.payload[2]):
                    at.payload[2] = owner
            rows.append((row_no, at.payload[0], at.payload[1], key, None, None, None, None, None))
            while trie.root.size > store and (found := trie.prune(False)):
                yield heads(found)
        if rows:
            yield dict(zip(names, [list(c) for c in zip(*rows, strict=True)], strict=True))
    if rest := list(strings(trie.root, b"")):
        yield heads(rest)


def settle(batches: Iterator[dict[str, list]], store: int) -> Iterator[dict[str, list]]:
    """The owner of every head whose string stayed in the trie; the heads of subtrees given up, with their texts."""
    trie, names = Trie(), ["nodes", "row_no", "id", "points", "size", "length", "hash", "subtree", "text"]

    def table(rows: list) -> dict[str, list]:
        return dict(zip(names, [list(c) for c in zip(*rows, strict=True)], strict=True))

    def out(found: list, gone: int | None) -> dict[str, list]:
        return table([
            (nodes, owner[2], owner[1], owner[0], size, len(text), key, gone, None if gone is None else text)
            for text, (nodes, owner, size, key) in found
        ])

    for batch in batches:
        passed = []
        for nodes, row_no, key, points, size, length, code, text in zip(*[batch[n] for n in ["nodes", "row_no", "id", "points", "size", "length", "hash", "text"]], strict=True):
            at, owner = trie.place(text), (points, key, row_no)
            if at.gone is not None:
                passed.append((nodes, row_no, key, points, size, length, code, int.from_bytes(at.gone, "little", signed=True), text))
            elif at.payload is None:
                at.payload = [nodes, owner, size, code]
            else:
                have = at.payload
                have[0] = have[0] + nodes
                have[1] = owner if before(owner, have[1]) else have[1]
                have[2] += size
            while trie.root.size > store:
                node, path = trie.largest()
                found = trie.prune(True)
                if not found:
                    break
                stub = trie_stub(node, found[0][0], path)
                yield out(found, int.from_bytes(stub, "little", signed=True))
        if passed:
            yield table(passed)
    if rest := list(strings(trie.root, b"")):
        yield out(rest, None)


def trie_stub(node: Node, text: bytes, path: bytes) -> bytes:
    return node.children[text[len(path)]].gone


def own_texts(cues: DataFrame, store: int = STORE) -> DataFrame:
    """The cue that stands for each text: of equal texts, the one with the most code points before blanks went.

    ``cues`` are the library's cues (cue_id, text); more columns, whatever their names, are
    not read.  One row per row of ``cues``: cue_id, keep_id (cue_id of the row that stays),
    group_size, kept, text_sha256 (of the text without blanks, in UTF-8).

    A null text is the empty text; empty texts and those of blanks alone are equal to each
    other.  Ties in code points go to the smallest cue_id, a null one last, then to the
    earliest row; of rows that share a cue_id still one alone is kept.  Texts of any length
    are compared whole.  An empty table gives an empty table.

    ``store`` bounds the strings in a task's trie; one string may exceed it.  A group of
    copies meets in one task as one head per flush of a task, never row by row.
    """
    kind = next(f.dataType for f in cues.schema if f.name == "cue_id").simpleString()
    rows = cues.select(
        F.monotonically_increasing_id().alias("row_no"), "cue_id", raw_text("text").alias("raw"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("points"),
    )
    first = f"row_no long, node long, sha binary, id {kind}, points long, size long, length long, hash long, text binary"
    entered = written(arrow_map(rows, first, partial(gather, store=store)), "cue-texts", compression="zstd")
    heads = entered.where("text IS NOT NULL").select(F.array("node").alias("nodes"), "row_no", "id", "points", "size", "length", "hash", F.lit(None).cast("long").alias("subtree"), "text")
    schema = T._parse_datatype_string(f"nodes array<long>, row_no long, id {kind}, points long, size long, length long, hash long, subtree long, text binary")
    owners = None
    while True:
        found = written(arrow_map(heads.repartition("length", "hash", "subtree"), schema, partial(settle, store=store)), "cue-owners", compression="zstd")
        done = found.where("text IS NULL").select(F.explode("nodes").alias("node"), F.col("row_no").alias("owner"), F.col("id").alias("keep_id"), F.col("size").alias("group_size"))
        owners = done if owners is None else owners.unionByName(done)
        heads = found.where("text IS NOT NULL")
        if heads.isEmpty():
            break
    members = entered.where("text IS NULL").select("row_no", F.col("id").alias("cue_id"), "node", "sha")
    return members.join(owners, "node").select(
        "cue_id", "keep_id", "group_size", (F.col("row_no") == F.col("owner")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"),
    )
