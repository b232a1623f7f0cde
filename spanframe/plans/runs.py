"""Runs whose next break depends on where they began, without a pass over a whole key.

Rows are cut into blocks.  Whatever run reaches a block, the block either lets it pass,
spoils it, or ends it at a row that depends on one number of the run alone; so a block is a
step function from that number to the state behind it.  Step functions compose, so states
travel over one small row per block, and every block is then labelled by itself.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import by_rows, pinned

ROWS = 65_536  # rows of a block
BLOCKS = 1_024  # blocks whose functions are composed in one task
PASS, SPOIL = 0, 1
LOW, HIGH = -(2**80), 2**80


def allowed(lo: int | None, hi: int | None, mod: int) -> list[tuple[int, int]]:
    """The numbers within a window, closed; on a circle of ``mod`` numbers unless that is 0."""
    if lo is None or mod and hi - lo + 1 >= mod:
        return [(LOW, HIGH)]
    if hi < lo:
        return []
    if not mod:
        return [(lo, hi)]
    at = lo % mod
    end = at + hi - lo
    return [(at, end)] if end < mod else [(0, end - mod), (at, mod - 1)]


def without(spans: list[tuple[int, int]], window: list[tuple[int, int]]) -> tuple[list, list]:
    """The parts of ``spans`` inside and outside ``window``; both are sorted and disjoint."""
    inside, outside = [], []
    for lo, hi in spans:
        at = lo
        for a, b in window:
            a, b = max(a, lo), min(b, hi)
            if a > b:
                continue
            if at < a:
                outside.append((at, a - 1))
            inside.append((a, b))
            at = b + 1
        if at <= hi:
            outside.append((at, hi))
    return inside, outside


class Block:
    """A block's rows: kind (0 plain, 1 a run may break here, 2 it must), number and cleanness of a run from here, window, place."""

    def __init__(self, kind: list, number: list, clean: list, lo: list, hi: list, mod: list, place: list):
        self.kind, self.number, self.clean, self.lo, self.hi, self.mod, self.place = kind, number, clean, lo, hi, mod, place
        self.ends: dict[int, list] = {}
        self.breaks = [len(kind)] * (len(kind) + 1)  # the first row from here on where a run may break
        for i in range(len(kind) - 1, -1, -1):
            self.breaks[i] = i if kind[i] else self.breaks[i + 1]

    def holds(self, i: int, number: int) -> bool:
        lo, hi, mod = self.lo[i], self.hi[i], self.mod[i]
        return lo is None or lo <= hi and ((number - lo) % mod <= hi - lo if mod else lo <= number <= hi)

    def walk(self, state: list, i: int, starts: list | None = None) -> list:
        """The state behind the block of a run that reaches row ``i``; ``starts`` takes the place each row's run began at."""
        number, clean, place = state
        path = []
        for i in range(i, len(self.kind)):
            kind = self.kind[i]
            if kind == 2 or kind == 1 and not (clean and self.holds(i, number)):
                if starts is None and i in self.ends:
                    number, clean, place = self.ends[i]
                    break
                path.append(i)
                number, clean, place = self.number[i], self.clean[i], self.place[i]
            elif clean and kind == 0:
                clean = self.holds(i, number)
            if starts is not None:
                starts.append(place)
        out = [number, clean, place]
        for j in path:
            self.ends[j] = out
        return out

    def begun(self, i: int) -> list:
        """The state behind the block of a run that begins at row ``i``."""
        if i not in self.ends:
            self.ends[i] = self.walk([self.number[i], self.clean[i], self.place[i]], i + 1)
        return self.ends[i]

    def function(self) -> dict:
        """The block as a step function of a clean run's number, and what becomes of a spoiled run."""
        n, left, steps = len(self.kind), [(LOW, HIGH)], []
        broken = lambda i: SPOIL if self.breaks[i] == n else self.begun(self.breaks[i])
        for i in range(n):
            if self.kind[i] == 2:
                steps += [(lo, self.begun(i)) for lo, _ in left]
                left = []
                break
            if self.lo[i] is None:
                continue
            left, out = without(left, allowed(self.lo[i], self.hi[i], self.mod[i]))
            steps += [(lo, broken(i)) for lo, _ in out]
            if not left:
                break
        steps += [(lo, PASS) for lo, _ in left]
        return {"steps": joined(sorted(steps, key=lambda s: s[0])), "spoiled": broken(0)}


def joined(steps: list) -> list:
    return [list(s) for k, s in enumerate(steps) if k == 0 or s[1] != steps[k - 1][1]]


def apply(f: dict, state: list) -> list:
    number, clean, place = state
    out = f["steps"][bisect_right(f["steps"], number, key=lambda s: s[0]) - 1][1] if clean else f["spoiled"]
    return [number, True, place] if out == PASS else [number, False, place] if out == SPOIL else out


def compose(f: dict, g: dict) -> dict:
    """First ``f``, then ``g``."""
    on = lambda out: g["spoiled"] if out == SPOIL else apply(g, out)
    steps = []
    ends = [s[0] for s in f["steps"][1:]] + [HIGH + 1]
    for (lo, out), end in zip(f["steps"], ends, strict=True):
        if out != PASS:
            steps.append((lo, on(out)))
            continue
        k = bisect_right(g["steps"], lo, key=lambda s: s[0]) - 1
        steps.append((lo, g["steps"][k][1]))
        steps += [(a, o) for a, o in g["steps"][k + 1 :] if a < end]
    return {"steps": joined(steps), "spoiled": on(f["spoiled"]) if f["spoiled"] != PASS else PASS}


def blocks_of(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, list[dict]]]:
    """The rows of each (keys, block) of a sorted partition, one block at a time."""
    at, held = None, []
    for b in batches:
        for row in b.to_pylist():
            key = (*[row[k] for k in keys], row["__block"])
            if held and key != at:
                yield at, held
                held = []
            at = key
            held.append(row)
    if held:
        yield at, held


def block(rows: list[dict]) -> Block:
    return Block(*[[r[c] for r in rows] for c in ("__kind", "__number", "__clean", "__lo", "__hi", "__mod", "__pos")])


def label_runs(rows: DataFrame, keys: list[str], carried: list[str], block_rows: int = ROWS, blocks: int = BLOCKS) -> DataFrame:
    """``keys``, ``carried`` and ``__run``: the place at which each row's run began.

    ``rows`` have a dense place ``__pos`` per key; ``__kind``; ``__number``, of a run that
    begins at the row; ``__clean``, whether such a run is; and a window ``__lo`` to ``__hi``
    (null: any; on a circle of ``__mod`` numbers unless that is 0).  A run breaks at a row of kind 2, and at
    one of kind 1 if it is spoiled or its number is outside the window; a row of kind 0 whose window it misses
    spoils it.  The first row of a key has kind 2.
    """
    kinds = dict(rows.dtypes)
    names = ["__kind", "__number", "__clean", "__lo", "__hi", "__mod", "__pos"]
    src = rows.withColumn("__block", by_rows(F.col("__pos") - 1, block_rows)).select(*keys, "__block", *names, *carried).repartition(*keys, "__block")
    ident = ", ".join(f"`{k}` {kinds[k]}" for k in keys)

    def functions(batches: Iterator[pa.RecordBatch]):
        for key, held in blocks_of(batches, keys):
            yield pa.RecordBatch.from_pylist([{**dict(zip([*keys, "__block"], key, strict=True)), "__f": json.dumps(block(held).function())}])

    def whole(group: pd.DataFrame) -> pd.DataFrame:
        out = None
        for text in group.sort_values("__block")["__f"]:
            out = json.loads(text) if out is None else compose(out, json.loads(text))
        return group[[*keys, "__super"]].head(1).assign(__f=json.dumps(out))

    def reached(at: str):
        def run(group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values(at)
            state, states = json.loads(group["__state"].iloc[0]), []
            for text in group["__f"]:
                states.append(json.dumps(state))
                state = apply(json.loads(text), state)
            return group[[*keys, at]].assign(__state=states)

        return run

    ordered = pinned(src).select(*keys, "__block", *names).sortWithinPartitions(*keys, "__block", "__pos")
    found = ordered.mapInArrow(functions, f"{ident}, __block bigint, __f string").withColumn("__super", by_rows("__block", blocks))
    begin = F.lit(json.dumps([0, False, -1]))
    supers = found.groupBy(*keys, "__super").applyInPandas(whole, f"{ident}, __super bigint, __f string")
    entered = supers.withColumn("__state", begin).groupBy(*keys).applyInPandas(reached("__super"), f"{ident}, __super bigint, __state string")
    states = found.join(entered, [*keys, "__super"]).groupBy(*keys, "__super").applyInPandas(reached("__block"), f"{ident}, __block bigint, __state string")

    def labels(batches: Iterator[pa.RecordBatch]):
        for _, held in blocks_of(batches, keys):
            starts: list[int] = []
            block(held).walk(json.loads(held[0]["__state"]), 0, starts)
            yield pa.RecordBatch.from_pylist([{**{c: r[c] for c in (*keys, *carried)}, "__run": s} for r, s in zip(held, starts, strict=True)], schema=arrow)

    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = ident + "".join(f", `{c}` {kinds[c]}" for c in carried) + ", __run bigint"
    arrow = to_arrow_schema(T._parse_datatype_string(schema))
    told = src.join(states, [*keys, "__block"]).sortWithinPartitions(*keys, "__block", "__pos")
    return told.mapInArrow(labels, schema)
