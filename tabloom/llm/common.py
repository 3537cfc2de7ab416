"""Shared helpers: table access, Arrow batch slicing, column selection."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.sources.store import materialise

#: White space that separates words everywhere in this subpackage: \x20 and \x09-\x0D.
SPACES = "[\\x20\\x09-\\x0D]"
WORD = "[^\\x20\\x09-\\x0D]+"

#: Bytes of an Arrow batch between Spark and Python workers, unless the session chose a size itself.
ARROW_BYTES = 4 << 20
_ARROW, _ARROW_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", 64 << 20


def prepare(spark: SparkSession) -> None:
    """Small Arrow batches: whole texts travel to Python, and several batches are in memory at a time on either side.

    DataFrames are lazy and read this setting when they run, so it stays set; a session that
    chose a size of its own, in whatever notation, keeps it.
    """
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(str(spark.conf.get(_ARROW))) == _ARROW_DEFAULT:
        spark.conf.set(_ARROW, ARROW_BYTES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(col: Column, m: int) -> Column:
    """crc32 of the value as text, modulo m; null counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")), F.lit(m))


def slices(batches: Iterator[pa.RecordBatch], limit: int, col: int = 1) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """Cut batches into runs of rows of about ``limit`` bytes of column ``col``.

    Gives each run with that column as a list of bytes (None for null). One text longer
    than the limit makes a run of its own, whole.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(col)
        wide = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else pa.binary())
        sizes = np.asarray(pc.fill_null(pc.binary_length(wide), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        ends = np.cumsum(sizes)
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(start, stop - start), wide.slice(start, stop - start).to_pylist()
            start = stop


def id_field(df: DataFrame, name: str) -> str:
    """The SQL type of a column, for the schema of an Arrow function."""
    return df.schema[name].dataType.simpleString()


#: At most so many keys are broadcast by ``lookup``.
HEAVY_KEYS = 20_000


def lookup(rows: DataFrame, found: DataFrame, key: str, times: str, total: int, least: int = 1_000) -> DataFrame:
    """Inner join of rows with found, which has one row for each key and in ``times`` how many rows ask for it.

    Keys of more than ``least`` rows, and more than total / HEAVY_KEYS, are answered by a
    broadcast: of these there are fewer than HEAVY_KEYS, as their rows add up to total. The
    others are joined by a shuffle, in which no key is large.
    """
    heavy = F.col(times) > max(least, total // HEAVY_KEYS)
    some = F.broadcast(found.where(heavy).drop(times))
    light = rows.join(F.broadcast(found.where(heavy).select(key)), key, "left_anti").join(found.where(~heavy).drop(times), key)
    return rows.join(some, key).unionByName(light)


def free(columns: list[str], name: str) -> str:
    """A column name like ``name`` that is not taken (names are compared as Spark does, without case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def quoted(name: str) -> str:
    """A column name as it stands in an expression; back quotes within it are doubled."""
    return f"`{name.replace('`', '``')}`"


def only(df: DataFrame, **columns: str) -> DataFrame:
    """Exactly the named input columns, under the operator's own names.

    Whatever else the table carries, also under names that the operator uses, stays outside.
    """
    return df.select(*[F.col(quoted(source)).alias(name) for name, source in columns.items()])


__all__ = ["SPACES", "WORD", "crc_mod", "free", "id_field", "lookup", "materialise", "only", "prepare", "quoted", "slices", "table"]
