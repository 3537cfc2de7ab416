"""Best-fit packing, bulk-synchronous.

Documents become token ids; only those above the capacity are cut. Pieces are range-sorted
by falling length (ties by id and piece) and ranked; gaps of open sequences are kept sorted,
too. Lengths and gaps are whole numbers up to the capacity, so pieces of one length, and
sequences with one gap, are interchangeable: each such class is one entry of the sorted
state, with its number of members, however many rows it stands for. The state is bounded by
the capacity and not by the data.

A round takes the next length of the sorted sweep. Its pieces ask for their successor, the
least gap that holds them; where more pieces ask than there are gaps, rank decides: the
first take it, the others go on to the next successor, and open new sequences when there is
none. Then the gaps are updated and the next round begins. This is exactly best-fit
decreasing. What a round decided is kept as runs (ranks of a length -> sequences, offset);
every partition of the sorted pieces then sweeps its own rows along the runs.

Null texts count as empty and pack as a single end token. Repeated rows are packed as often
as they stand there. Empty tables give empty results.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import free, id_field, materialise, only, slices
from tabloom.llm.tokens import PART_BYTES, encoder, parts, units

END = 1


def pieces(df: DataFrame, tokenizer: str, capacity: int = 4096, id_col: str = "doc_id", text_col: str = "text", slice_bytes: int = 2 << 20) -> DataFrame:
    """Per piece: the id, piece, start, length and ids_crc32 (of little-endian unsigned 32-bit ids)."""
    names = [id_col, "piece", "start", "length", "ids_crc32"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(tokenizer)
        end, step = END.to_bytes(4, "little"), 4 * capacity
        for batch, texts in slices(batches, slice_bytes):
            # the memo may be emptied when it is full, so all words are learnt, known or not
            rows: list[tuple[int, int, int, int, int]] = []

            def cut(at: int, data: bytes, done: int, last: bool, rows: list = rows) -> bytes:
                """Note the whole pieces of data, which follows ``done`` bytes of its text; give back what is left of it."""
                stop = len(data) if last else len(data) // step * step
                for start in range(0, stop, step):
                    part = data[start : min(start + step, stop)]
                    rows.append((at, (done + start) // step, (done + start) >> 2, len(part) >> 2, zlib.crc32(part)))
                return data[stop:]

            if len(texts) == 1 and len(texts[0] or b"") > PART_BYTES:  # a long text: part by part, whole pieces leave at once
                rest, done = b"", 0
                for p in parts(texts[0]):
                    words = units(p)
                    known.learn(set(words))
                    data = rest + b"".join(map(known.ids.__getitem__, words))
                    rest = cut(0, data, done, False)
                    done += len(data) - len(rest)
                cut(0, rest + end, done, True)
            else:
                split = [units(t) for t in texts]
                known.learn(set().union(*split))
                of = known.ids.__getitem__
                for at, words in enumerate(split):
                    data = b"".join(map(of, words)) + end
                    if len(data) <= step:
                        rows.append((at, 0, 0, len(data) >> 2, zlib.crc32(data)))
                    else:
                        cut(at, data, 0, True)
            at, *rest = zip(*rows, strict=True)
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int32())), *(pa.array(x, k) for x, k in zip(rest, kinds, strict=True))], names=names)

    return only(df, **{id_col: id_col, "__text": text_col}).mapInArrow(work, f"`{id_col}` {id_field(df, id_col)}, piece int, start long, length long, ids_crc32 long")


def plan_runs(counts: dict[int, int], capacity: int) -> dict[int, np.ndarray]:
    """Best-fit decreasing over classes of equal length: counts gives how many pieces have each length.

    Per length an array of runs (first rank, first sequence, step, offset): the r-th piece of
    the length lies in the last run whose first rank is at most r, in sequence
    ``first sequence + step * (r - first rank)``.
    """
    gaps: list[int] = []
    open_at: dict[int, list[tuple[int, int]]] = {}  # gap -> (first sequence, how many)
    used = 0
    runs: dict[int, np.ndarray] = {}

    def give(gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in open_at:
                insort(gaps, gap)
                open_at[gap] = []
            open_at[gap].append((first, n))

    for length in sorted(counts, reverse=True):
        left, rank, out = counts[length], 0, []
        while left:
            place = bisect_left(gaps, length)
            if place == len(gaps):  # no gap holds it: new sequences, filled with this length as best fit would
                each = capacity // length
                full, some = divmod(left, each)
                for k in range(each if full else 0):
                    out.append((rank + k * full, used, 1, k * length))
                give(capacity - each * length, used, full)
                for k in range(some):
                    out.append((rank + each * full + k, used + full, 1, k * length))
                give(capacity - some * length, used + full, 1 if some else 0)
                used += full + (1 if some else 0)
                break
            gap = gaps[place]
            first, n = open_at[gap].pop()
            take = min(n, left)
            out.append((rank, first, 1, capacity - gap))
            if n > take:
                open_at[gap].append((first + take, n - take))
            if not open_at[gap]:
                del open_at[gap]
                gaps.pop(place)
            give(gap - length, first, take)
            rank, left = rank + take, left - take
        runs[length] = np.array(out, np.int64)
    return runs


def pack(found: DataFrame, capacity: int = 4096, id_col: str = "doc_id") -> DataFrame:
    """Add sequence_id and offset to pieces (columns id_col, piece, length at least)."""
    spark = found.sparkSession
    columns = found.columns
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # rows that agree in all are interchangeable; a salt lets their ranges be cut, too
    salt = free(columns, "salt")
    order = [F.col("length").desc(), F.col(f"`{id_col}`"), F.col("piece"), F.col(salt)]
    salted = found.withColumn(salt, F.xxhash64(F.monotonically_increasing_id()))
    ordered = salted.repartitionByRange(ranges, *order).sortWithinPartitions(*order).drop(salt).withColumn("__part", F.spark_partition_id())
    length_at = columns.index("length")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema.fields)

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Ranks among equal lengths of one partition; the rows come sorted."""
        held, seen = None, 0
        for batch in batches:
            lengths = batch.column(length_at).to_numpy(zero_copy_only=False)
            if not len(lengths):
                continue
            starts = np.flatnonzero(np.concatenate(([True], lengths[1:] != lengths[:-1])))
            ranks = np.arange(len(lengths)) - np.repeat(starts, np.diff(np.append(starts, len(lengths))))
            if held == lengths[0]:
                ranks[: starts[1] if len(starts) > 1 else None] += seen
            held, seen = lengths[-1], int(ranks[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ranks, pa.int64())], names=[*columns, "__part", "__rank"])

    ranked = materialise(ordered.mapInArrow(rank, kinds + ", __part int, __rank long"), "pack-ranked")
    # sorted ranges: at most one row for each length and one more for each partition
    counts: dict[int, int] = {}
    before: dict[tuple[int, int], int] = {}
    for row in sorted(ranked.groupBy("__part", "length").count().collect(), key=lambda r: (r[0], -r[1])):
        before[row[0], row[1]] = counts.get(row[1], 0)
        counts[row[1]] = counts.get(row[1], 0) + row[2]
    runs = plan_runs(counts, capacity)
    offsets: dict[int, dict[int, int]] = {}
    for (part, length), n in before.items():
        if n:
            offsets.setdefault(length, {})[part] = n

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wide = len(columns)
        for batch in batches:
            lengths, part, ranks = (batch.column(i).to_numpy(zero_copy_only=False) for i in (length_at, wide, wide + 1))
            sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
            for length in np.unique(lengths).tolist():
                own = np.flatnonzero(lengths == length)
                r = ranks[own] + (np.array([offsets[length].get(p, 0) for p in part[own].tolist()], np.int64) if length in offsets else 0)
                run = runs[length]
                row = run[np.searchsorted(run[:, 0], r, side="right") - 1]
                sequence[own] = row[:, 1] + row[:, 2] * (r - row[:, 0])
                offset[own] = row[:, 3]
            yield pa.RecordBatch.from_arrays([*batch.columns[:wide], pa.array(sequence), pa.array(offset)], names=[*columns, "sequence_id", "offset"])

    return ranked.mapInArrow(assign, kinds + ", sequence_id long, offset long")


def tokenize_and_pack(df: DataFrame, tokenizer: str, capacity: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece: the id, piece, start, length, ids_crc32, sequence_id and offset."""
    return pack(materialise(pieces(df, tokenizer, capacity, id_col, text_col), "pack-pieces"), capacity, id_col)
