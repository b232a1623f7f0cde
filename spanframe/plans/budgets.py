"""Reservations against budgets in order, without a pass over a whole budget.

A request fits if it is at most what is left, and what is left only falls.  With R left and
2^k <= R < 2^(k+1), a block of requests is settled from sums alone where all requests below
2^(k+1) fit together, or all below 2^k do and none between ever fits.  In any other block what is
left falls below 2^k, so a budget has at most 63 blocks that must be opened to go on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .ordered import by_rows, positions
from .rounds import cut_lineage

ROWS = 65_536  # requests of a block
CLASSES = 63
NEVER = 2**63 - 1


def block_sums(amounts: list[int]) -> tuple[list[int], list[int]]:
    """By k: the sum of amounts below 2^k, and the least that must be left for one of 2^k to 2^(k+1) to fit when all below do."""
    sums, least = [], []
    for k in range(CLASSES):
        low, high, before, need = 1 << k, 1 << (k + 1), 0, NEVER
        for a in amounts:
            if a < low:
                before += a
            elif a < high:
                need = min(need, a + before)
        sums.append(min(before, NEVER))
        least.append(min(need, NEVER))
    return sums, least


def quick_sums(amounts: np.ndarray) -> tuple[list[int], list[int]]:
    """``block_sums`` for amounts whose sums fit 63 bits."""
    sums, least = [0] * CLASSES, [NEVER] * CLASSES
    for k in range(CLASSES):
        small, here = amounts < (1 << k), (amounts >= (1 << k)) & (amounts < (1 << min(k + 1, 62)))
        before = np.cumsum(np.where(small, amounts, 0))
        sums[k] = int(before[-1])
        if here.any():
            least[k] = int((amounts + before)[here].min())
    return sums, least


def left_after(left: int, sums: list[int], least: list[int]) -> int | None:
    """What is left behind a block, or None if the block must be opened."""
    if left <= 0:
        return left  # only amounts of 0 fit, if any
    k = left.bit_length() - 1
    if k + 1 < CLASSES and sums[k + 1] <= left and sums[k + 1] < NEVER:
        return left - sums[k + 1]
    if sums[k] <= left and least[k] > left:
        return left - sums[k]
    return None


def grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[list[dict]]:
    """Rows of one (key, block) of a sorted partition at a time."""
    held: list[dict] = []
    for b in batches:
        for row in b.to_pylist():
            if held and (row[key], row["__block"]) != (held[0][key], held[0]["__block"]):
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def settle(rows: DataFrame, key: str, order: list[str], block_rows: int = ROWS) -> DataFrame:
    """``rows`` (key, columns of ``order``, amount, limit) with ``accepted`` and ``left`` behind each.

    The amount is not NULL; a negative one is refused.
    """
    kinds, limit = dict(rows.dtypes), "limit"
    placed = positions(rows, [key], order, F.coalesce(by_rows(order[0]), F.lit(-(2**62)).cast("bigint")) if kinds[order[0]] in ("bigint", "int") else F.lit(0), "__pos")
    placed = cut_lineage(placed.withColumn("__block", by_rows(F.col("__pos") - 1, block_rows)))
    many = cut_lineage(placed.groupBy(key).agg(F.max("__block").alias("__last"), F.first(limit).alias("left")).where("__last > 0"))

    def sums(batches: Iterator[pa.RecordBatch]):
        for held in grouped(batches, key):
            amounts = [r["amount"] for r in held if r["amount"] >= 0]
            quick = not amounts or max(amounts) < 2**62 // (2 * len(amounts))
            s, c = quick_sums(np.array(amounts, np.int64)) if amounts and quick else block_sums(amounts)
            yield pa.RecordBatch.from_pylist([{key: held[0][key], "__block": held[0]["__block"], "sums": s, "least": c}], schema=summary)

    def walk(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("__block")
        left, out = int(group["left"].iloc[0]), []
        for b, s, c in zip(group["__block"], group["sums"], group["least"], strict=True):
            after = left_after(left, [int(x) for x in s], [int(x) for x in c])
            out.append((group[key].iloc[0], b, left, after is None))
            if after is None:
                break
            left = after
        return pd.DataFrame(out, columns=[key, "__block", "left", "opened"])

    def fold(out_schema: pa.Schema, whole: bool):
        def run(batches: Iterator[pa.RecordBatch]):
            for held in grouped(batches, key):
                left, rows = held[0]["left"], []
                for r in held:
                    fits = 0 <= r["amount"] <= left
                    left -= r["amount"] if fits else 0
                    if whole:
                        rows.append({**{c: r[c] for c in kinds}, "accepted": fits, "left": left})
                rows = rows if whole else [{key: held[0][key], "__next": held[0]["__block"] + 1, "left": left}]
                yield pa.RecordBatch.from_pylist(rows, schema=out_schema)

        return run

    dealt = lambda df: df.repartition(key, "__block").sortWithinPartitions(key, "__block", "__pos")
    arrow = lambda ddl: to_arrow_schema(T._parse_datatype_string(ddl))
    ident = f"`{key}` {kinds[key]}"
    begun = None
    if not many.isEmpty():
        ddl = f"{ident}, __block bigint, sums array<bigint>, least array<bigint>"
        summary = arrow(ddl)
        hot = placed.join(many.select(key), key, "left_semi")
        table = cut_lineage(dealt(hot.select(key, "__block", "__pos", "amount")).mapInArrow(sums, ddl))
        state = many.select(key, F.lit(0).cast("bigint").alias("__next"), "left")
        while True:
            walked = cut_lineage(table.join(state, key).where("__block >= __next").groupBy(key).applyInPandas(walk, f"{ident}, __block bigint, left bigint, opened boolean"))
            begun = walked.select(key, "__block", "left") if begun is None else begun.unionByName(walked.select(key, "__block", "left"))
            opened = walked.where("opened").select(key, "__block", "left")
            if opened.isEmpty():
                break
            ddl = f"{ident}, __next bigint, left bigint"
            state = cut_lineage(dealt(hot.join(F.broadcast(opened) if opened.count() <= 100_000 else opened, [key, "__block"])).mapInArrow(fold(arrow(ddl), False), ddl))
    first = placed.select(key, "__block", F.col(limit).alias("left")).where("__block = 0").distinct()
    begun = first if begun is None else begun.unionByName(first.join(many.select(key), key, "left_anti"))
    ddl = ", ".join(f"`{c}` {t}" for c, t in kinds.items()) + ", accepted boolean, left bigint"
    return dealt(placed.join(begun, [key, "__block"])).mapInArrow(fold(arrow(ddl), True), ddl)
