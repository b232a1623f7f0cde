"""Helpers shared by the text operators: byte words, Arrow steps, written tables."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.rounds import written

ASCII_WORD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def plain_words(raw: bytes | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of UTF-8 ``raw``, A-Z lower-cased; none for null."""
    return raw.translate(ASCII_WORD).split() if raw else []


def blank_words(raw: bytes | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of UTF-8 ``raw``, A-Z lower-cased; none for null."""
    return raw.lower().split() if raw else []


def raw_text(name: str):
    """A text column as UTF-8 bytes, which split faster than strings."""
    return F.col(name).cast("string").cast("binary")


def arrow_map(df: DataFrame, schema: str | T.StructType, step: Callable[[Iterator[dict[str, list]]], Iterable[dict[str, list]]]) -> DataFrame:
    """``mapInArrow`` with batches as column lists.

    ``step`` gets all batches of a task, so that it can keep a cache, and yields column
    lists; it is a generator and holds one batch at a time.
    """
    kind = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in step({n: b.column(i).to_pylist() for i, n in enumerate(b.schema.names)} for b in batches):
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, kind)


def discard(*tables: DataFrame) -> None:
    """Deletes the files of written tables that nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.written_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def joinable(table: DataFrame, rows: int) -> DataFrame:
    """A written table for a join: broadcast while it has at most ``rows`` rows, else merged by key.

    The count decides, not an estimate of bytes, so that small and large inputs run alike.
    """
    return F.broadcast(table) if table.count() <= rows else table.hint("merge")


def crc_rest(column: str, divisor: int):
    """Remainder of the CRC-32 of ``column`` as text."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % divisor


__all__ = ["ASCII_WORD", "arrow_map", "blank_words", "crc_rest", "discard", "joinable", "plain_words", "raw_text", "written"]
