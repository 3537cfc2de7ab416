"""Exact rolling medians and median absolute deviations of time series, by offline parallel bisection.

The values of a stretch of windows are sorted once. A round of the first bisection halves the
range of values that each window's median can lie in, for all windows together: the sorted
values are swept into prefix counts over time, one count for the lower half of every range,
and two look-ups of a prefix count tell how many of a window's values fall there. Rounds
keep the values of a range together in order of time, so a round is a handful of vector
operations whatever the number of windows (``Levels``).

The second bisection finds the radius around each median that holds half of the window, again
for all windows together: a round counts the values within the middle radius by prefix counts,
and keeps the half that holds the answer. It starts between the distances of the two ends
of the middle half, so it has few rounds.

Spark deals the work. Clicks are counted by (series, time, value) first. Time is cut into cells
of ``CELL`` windows; a point goes to its own cell and, if a window of the next cell can reach
it, there, too. A hot series is as many cells as it has times. Partitions are read in order
and worked on in stretches of whole cells, so a task holds a stretch or one cell.

Times are exact microseconds without a zone. Windows are open at their start and closed at
their end, so all clicks at one time share a window: it is found once, however many they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType

from tabloom.llm.common import lookup, materialise, only

#: Windows to a cell of time.
CELL = 2
#: Points worked on together; a cell is never cut, so one of more points is a stretch of its own.
STRETCH = 8_192
#: Values beyond this many units are taken as this many, so that doubled distances stay whole numbers of 64 bits.
BOUND = 1 << 58
_SHIFT = 44


class Levels:
    """Counts and order statistics of the values in ranges of positions, for many ranges at a time.

    Values are whole numbers with weights. Level by level the values are dealt by one bit of
    their rank, lower half first, keeping the order of positions within a half. ``zeros`` has,
    for each level, how many before a position belong to the lower half; ``weights`` the
    running weight in the order of the next level.
    """

    def __init__(self, values: np.ndarray, weights: np.ndarray) -> None:
        self.distinct, rank = np.unique(values, return_inverse=True)
        self.first = np.concatenate(([0], np.cumsum(weights)))
        self.zeros, self.weights, self.low = [], [], []
        self.bits = int(len(self.distinct)).bit_length()
        for bit in reversed(range(self.bits)):
            upper = (rank >> bit) & 1
            zeros = np.concatenate(([0], np.cumsum(1 - upper)))
            order = np.argsort(upper, kind="stable")
            rank, weights = rank[order], weights[order]
            self.zeros.append(zeros)
            self.low.append(int(zeros[-1]))
            self.weights.append(np.concatenate(([0], np.cumsum(weights))))

    def total(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return self.first[right] - self.first[left]

    def select(self, left: np.ndarray, right: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The k-th smallest value (from 0, by weight) at positions left to right; k must be below their weight."""
        rank = np.zeros(len(k), np.int64)
        for zeros, low, weights in zip(self.zeros, self.low, self.weights, strict=True):
            a, b = zeros[left], zeros[right]
            held = weights[b] - weights[a]
            up = k >= held
            k = k - np.where(up, held, 0)
            left, right = np.where(up, low + left - a, a), np.where(up, low + right - b, b)
            rank = 2 * rank + up
        return self.distinct[rank]

    def below(self, left: np.ndarray, right: np.ndarray, x: np.ndarray) -> np.ndarray:
        """The weight of values less than x at positions left to right."""
        aim = np.searchsorted(self.distinct, x)
        found = np.zeros(len(aim), np.int64)
        for i, (zeros, low, weights) in enumerate(zip(self.zeros, self.low, self.weights, strict=True)):
            a, b = zeros[left], zeros[right]
            up = (aim >> (self.bits - 1 - i)) & 1 == 1
            found += np.where(up, weights[b] - weights[a], 0)
            left, right = np.where(up, low + left - a, a), np.where(up, low + right - b, b)
        return found


def medians(values: np.ndarray, weights: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """n, doubled median and doubled median of \\|2 * value - doubled median\\| for ranges of positions; empty ranges give zeros."""
    n, m, r = (np.zeros(len(left), np.int64) for _ in range(3))
    if not len(values):
        return n, m, r
    levels = Levels(values, weights)
    n = levels.total(left, right)
    some = np.flatnonzero(n)
    a, b, k = left[some], right[some], n[some]
    low, high = (k - 1) // 2, k // 2
    m[some] = mid = levels.select(a, b, low) + levels.select(a, b, high)
    # a block of low + 1 neighbours in order of value holds enough: its farther end bounds the radius, its nearer end is reached
    at = (k - 1 - low) // 2
    ends = mid - 2 * levels.select(a, b, at), 2 * levels.select(a, b, at + low) - mid
    least, most = np.minimum(*ends), np.maximum(*ends)
    open_ = np.flatnonzero(least < most)
    while len(open_):
        half = (least[open_] + most[open_]) >> 1
        c = mid[open_]
        inside = _within(levels, a[open_], b[open_], c, half)
        enough = inside > low[open_]
        most[open_] = np.where(enough, half, most[open_])
        least[open_] = np.where(enough, least[open_], half + 1)
        open_ = open_[least[open_] < most[open_]]
    radius = most
    under = levels.below(a, b, -((radius - mid) // 2))  # values below the radius; ceil((mid - radius) / 2)
    upto = levels.below(a, b, (mid + radius) // 2 + 1)
    nearer = mid - 2 * levels.select(a, b, np.maximum(under - 1, 0))
    farther = 2 * levels.select(a, b, np.minimum(upto, k - 1)) - mid
    nearer, farther = np.where(under > 0, nearer, BOUND * 8), np.where(upto < k, farther, BOUND * 8)
    r[some] = radius + np.where(upto - under > high, radius, np.minimum(nearer, farther))
    return n, m, r


def _within(levels: Levels, left: np.ndarray, right: np.ndarray, mid: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """How many values v have |2 * v - mid| <= radius."""
    q = len(left)
    found = levels.below(np.tile(left, 2), np.tile(right, 2), np.concatenate(((mid + radius) // 2 + 1, -((radius - mid) // 2))))
    return found[:q] - found[q:]


def micros(df: DataFrame, column: str) -> Column:
    """Microseconds since 1970 of a timestamp; one without a zone is read off the clock, so the session's zone has no part in it."""
    t = F.col(f"`{column}`")
    if not isinstance(df.schema[column].dataType, TimestampNTZType):
        return F.unix_micros(t.cast("timestamp"))
    day = F.unix_date(t.cast("date")).cast("long")
    seconds = (day * 24 + F.hour(t)) * 3600 + F.minute(t) * 60
    return seconds * 1_000_000 + (F.date_part(F.lit("SECOND"), t) * 1_000_000).cast("long")


def units(value: Column, scale: int = 100) -> Column:
    """floor(scale * value + 0.5); null for null, NaN and infinite values."""
    x = F.lit(float(scale)) * value.cast("double") + 0.5
    finite = ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.when(finite, F.floor(F.greatest(F.least(x, F.lit(float(BOUND))), F.lit(-float(BOUND))))).cast("long")


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Whole cells, STRETCH points or more together, of batches in order of cells."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < STRETCH:
            continue
        cell = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        turns = np.flatnonzero((np.diff(cell[0]) != 0) | (np.diff(cell[1]) != 0))
        if len(turns):
            cut = int(turns[-1]) + 1
        elif len(held) > 1 and tuple(held[-2].column(i)[-1].as_py() for i in (0, 1)) != (int(cell[0][0]), int(cell[1][0])):
            cut = 0
        else:
            continue
        yield pa.Table.from_batches([*held[:-1], batch.slice(0, cut)])
        held, rows = [batch.slice(cut)], batch.num_rows - cut
    if rows:
        yield pa.Table.from_batches(held)


def _solve(cells: pa.Table, window: int, length: int) -> pa.RecordBatch:
    """The windows of some whole cells, one row for each (series, time) of a cell's own points."""
    key, cell, at, weight, value = (cells.column(i).combine_chunks() for i in range(5))
    filled = np.asarray(value.is_valid())
    key, cell, at, weight = (np.asarray(x) for x in (key, cell, at, weight))
    value = np.asarray(value.fill_null(0))
    new = np.concatenate(([0], np.cumsum((np.diff(key) != 0) | (np.diff(cell) != 0))))
    place = (new.astype(np.int64) << _SHIFT) + (at - cell * length + window)
    points = place[filled]
    own = at >= cell * length
    spots = np.flatnonzero(own & np.concatenate(([True], np.diff(place) != 0)))
    ends = place[spots]
    right = np.searchsorted(points, ends, side="right")
    left = np.searchsorted(points, ends - window, side="right")
    n, m, r = medians(value[filled], weight[filled], left, right)
    none = pa.array(n == 0)
    empty = pa.scalar(None, pa.int64())
    columns = [pa.array(key[spots]), pa.array(at[spots]), pa.array(n), *(pa.compute.if_else(none, empty, pa.array(x)) for x in (m, r))]
    return pa.RecordBatch.from_arrays(columns, ["series", "at", "n", "median2", "mad4"])


def rolling_medians(points: DataFrame, window: int) -> DataFrame:
    """(series, at, n, median2, mad4) for each distinct series and time of points (series long, at long, value long or null, weight long).

    A window is everything of its series from after ``at - window`` to ``at``. Points without
    a value have windows but aren't in any.
    """
    length = CELL * window
    if 2 * (length + window) >= 1 << _SHIFT:
        raise ValueError("windows may be up to 16 days long")
    cell = F.floor(F.col("at") / F.lit(length)).cast("long")
    cell = F.when(F.col("at") - cell * length < 0, cell - 1).when(F.col("at") - cell * length >= length, cell + 1).otherwise(cell)
    late = F.col("at") - F.col("own") * length > length - window
    dealt = points.withColumn("own", cell).withColumn("cell", F.explode(F.when(late, F.array(F.col("own"), F.col("own") + 1)).otherwise(F.array("own"))))
    parts = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = dealt.select("series", "cell", "at", "weight", "value").repartition(parts, "series", "cell").sortWithinPartitions("series", "cell", "at", "value")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for stretch in _stretches(batches):
            yield _solve(stretch, window, length)

    return ordered.mapInArrow(work, "series long, at long, n long, median2 long, mad4 long")


def rolling_far(clicks: DataFrame, minutes: int = 15, scale: int = 100, click_id: str = "click_id", ts: str = "ts", series: str = "kind", value: str = "value") -> DataFrame:
    """Every click once, with its window's count, doubled median, quadrupled deviation, and whether it lies far off.

    Columns: click_id, kind (as they came), n, median2, mad4, far. Clicks of a null time are
    dropped. Rows of one id are one click; if they differ, the earliest is taken, at equal
    times the least in order of series and value, nulls first; rows without an id are one click.
    Null is a series. Values that are null, NaN or infinite are no part of a window, and far is
    null for them; so are median2, mad4 and far of an empty window. An empty table gives no rows.

    far: the value's distance from the median is over twice the median distance.
    """
    rows = only(clicks, click_id=click_id, ts=ts, kind=series, value=value)
    rows = rows.select("click_id", "kind", micros(rows, "ts").alias("at"), units(F.col("value"), scale).alias("value")).where("at IS NOT NULL")
    once = rows.groupBy("click_id").agg(F.min(F.struct("at", "kind", "value")).alias("s")).select("click_id", "s.*")
    # a series goes by its 64-bit hash; null has a text of its own
    once = materialise(once.withColumn("series", F.xxhash64(F.coalesce(F.concat(F.lit("k"), F.col("kind").cast("string")), F.lit("n")))), "clicks")
    points = once.groupBy("series", "at", "value").agg(F.count("*").alias("weight"))
    found = rolling_medians(points, minutes * 60_000_000).withColumn("spot", F.struct("series", "at")).drop("series", "at")
    times = once.groupBy(F.struct("series", "at").alias("spot")).agg(F.count("*").alias("times"))
    asked = materialise(found.join(times, "spot"), "windows")
    total = once.count()
    answers = lookup(once.withColumn("spot", F.struct("series", "at")), asked, "spot", "times", total)
    far = 2 * F.abs(2 * F.col("value") - F.col("median2")) > 2 * F.col("mad4")
    return answers.select("click_id", "kind", "n", "median2", "mad4", far.alias("far"))
