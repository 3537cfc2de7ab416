"""Correlations of all pairs of many columns, from sums of products that blocks of rows give as matrices.

For a pair of columns only rows where both are filled count. With x the values (0 where
missing) and m the filled marks, six matrix products over a block of rows hold all that is
needed of every pair: m'm, x'm, m'x, (x^2)'m, m'(x^2), x'x. They add up over rows, so a task sums its
rows' matrices, and tasks are added up in two steps, tile by tile. Values are taken from their
column's mean, found in one pass before, so that nothing cancels.

Columns go in panels of ``PANEL``: a table of up to that many is read once for its means and once for all its
pairs. Of a wider table each pair of panels reads its own columns, so the sums of a task stay bounded.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations_with_replacement, pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.functions.exprs import finite, num

PANEL, TILE, ROWS, SALTS = 1_024, 128, 4_096, 16
_TILES = "a int, b int, salt int, sums binary"


def _products(x: np.ndarray, own: list[slice], pairs: list[tuple[int, int]], sums: dict) -> None:
    """Add the six products of some rows to the sums of each pair of tiles."""
    m = ~np.isnan(x)
    x = np.where(m, x, 0.0)
    m = m.astype(np.float64)
    s = x * x
    for i, j in pairs:
        a, b = own[i], own[j]
        got = np.stack([m[:, a].T @ m[:, b], x[:, a].T @ m[:, b], m[:, a].T @ x[:, b], s[:, a].T @ m[:, b], m[:, a].T @ s[:, b], x[:, a].T @ x[:, b]])
        sums[i, j] = sums[i, j] + got if (i, j) in sums else got


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tiles in order of (a, b, salt): one row for each, the sum of its rows."""
    key, total = None, None
    out = lambda: pa.RecordBatch.from_arrays([*(pa.array([k], pa.int32()) for k in key), pa.array([total.tobytes()], pa.binary())], ["a", "b", "salt", "sums"])
    for batch in batches:
        for *place, sums in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            part = np.frombuffer(sums)
            if place == key:
                total = total + part
                continue
            if key is not None:
                yield out()
            key, total = place, part
    if key is not None:
        yield out()


def pair_sums(df: DataFrame, columns: Sequence[str], means: Sequence[float], pairs: list[tuple[int, int]], own: list[slice]) -> DataFrame:
    """(a, b, salt, sums) of each pair of tiles, one row each."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        center = np.array(means)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                _products(np.column_stack([c.to_numpy(zero_copy_only=False) for c in part.columns]) - center, own, pairs, sums)
        salt = TaskContext.get().partitionId() % SALTS
        for (i, j), s in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([j], pa.int32()), pa.array([salt], pa.int32()), pa.array([s.tobytes()], pa.binary())], ["a", "b", "salt", "sums"])

    values = df.select(*[finite(num(F.col(f"`{c}`"))).cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    tiles = values.mapInArrow(work, _TILES)
    some = tiles.repartition("a", "b", "salt").sortWithinPartitions("a", "b", "salt").mapInArrow(_added, _TILES)
    return some.withColumn("salt", F.lit(0)).repartition("a", "b").sortWithinPartitions("a", "b").mapInArrow(_added, _TILES)


def correlations(df: DataFrame, columns: Sequence[str], least: float = 0.0) -> DataFrame:
    """(a, b, n, r) of each pair of columns in their order, over the n rows where both are filled; only |r| >= least.

    Text that is no number, NaN and infinite values are missing. A pair has no row if one of the two does not vary
    over the rows that count, or if there are fewer than two. Repeated names count once; an empty table gives no rows.
    """
    columns = list(dict.fromkeys(columns))
    spark = df.sparkSession
    out = spark.createDataFrame([], "a string, b string, n long, r double")
    if len(columns) < 2:
        return out
    row = df.agg(*[F.avg(finite(num(F.col(f"`{c}`")))).alias(f"c{i}") for i, c in enumerate(columns)]).first()
    means = [v if v is not None and np.isfinite(v) else 0.0 for v in row]
    tiles = [range(i, min(i + TILE, len(columns))) for i in range(0, len(columns), TILE)]
    panels = [range(i, min(i + PANEL // TILE, len(tiles))) for i in range(0, len(tiles), PANEL // TILE)]
    for p, q in combinations_with_replacement(panels, 2):
        used = list(dict.fromkeys([*p, *q]))
        places = [c for t in used for c in tiles[t]]
        ends = np.cumsum([0, *[len(tiles[t]) for t in used]]).tolist()
        own = [slice(a, b) for a, b in pairwise(ends)]
        met = [(used.index(i), used.index(j)) for i in p for j in q if i <= j]
        names = [columns[i] for i in places]

        def pairs(batches: Iterator[pa.RecordBatch], names: list[str] = names, own: list[slice] = own) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i, j, sums in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3)), strict=True):
                    n, sx, sy, sxx, syy, sxy = np.frombuffer(sums).reshape(6, own[i].stop - own[i].start, -1)
                    with np.errstate(all="ignore"):
                        vx, vy = sxx - sx * sx / n, syy - sy * sy / n
                        r = (sxy - sx * sy / n) / np.sqrt(vx * vy)
                    fit = (n > 1) & (vx > 1e-12 * sxx) & (vy > 1e-12 * syy) & (np.abs(r) >= least)
                    if i == j:
                        fit &= np.triu(np.ones(fit.shape, bool), 1)
                    a, b = np.nonzero(fit)
                    left, right = ([names[s.start + k] for k in at] for s, at in ((own[i], a), (own[j], b)))
                    yield pa.RecordBatch.from_arrays([pa.array(left, pa.string()), pa.array(right, pa.string()), pa.array(n[a, b].astype(np.int64)), pa.array(np.clip(r[a, b], -1, 1))], ["a", "b", "n", "r"])

        out = out.unionAll(pair_sums(df, names, [means[i] for i in places], met, own).mapInArrow(pairs, "a string, b string, n long, r double"))
    return out
