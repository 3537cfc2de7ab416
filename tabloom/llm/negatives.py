"""Hard negatives: for each anchor and positive, the best other-label vectors whose score lies in a window.

A search among vectors sorted by norm. Vectors become whole numbers (floor(scale * x)). They are
range-sorted by falling norm and cut into buckets of ``BUCKET``; a bucket knows its largest
norm. Anchors, a stated share of all rows, come in blocks of ``BLOCK``, by hash of their ids.
A block and a stripe of the buckets (every ``stripes``-th, from the longest down) are one unit of
work: buckets stream past the block in order, and a task holds one of them at a time.

By Cauchy-Schwarz no score in a bucket passes the product of the anchor's norm and the
bucket's largest. An anchor skips a bucket, and with it all that follow, if that product is below

- its running kth score, when it looks for positives,
- for each of its windows, the greater of the window's lower limit and its running kth score,
  when it looks for negatives.

What an anchor does not skip is scored by one matrix product for block and bucket. Ties go to
the smaller id, so a score equal to the running kth still counts. The best of all stripes are
merged by a ranking per anchor, or per anchor and positive: a few rows for each stripe.

Scores are exact while sums of products stay below 2^53.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.llm.common import materialise, only
from tabloom.sources.store import forget

#: Vectors to a bucket, anchors to a block.
BUCKET, BLOCK = 1_024, 512
_NONE = -math.inf


def whole_vectors(table: DataFrame, scale: float, vec_id: str, embedding: str, label: str) -> DataFrame:
    """id, label, v (array of double, whole numbers), norm2, size of the rows that take part, each id once.

    Rows with a null id, label or vector, an empty vector or a null or non-finite component
    take no part. Of several rows of one id the one of the least label counts, then the least vector.
    """
    rows = only(table, id=vec_id, label=label, v=embedding).where("id IS NOT NULL AND label IS NOT NULL AND size(v) > 0")
    rows = rows.select(F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), F.col("v").cast("array<double>").alias("v"))
    broken = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(~broken).withColumn("v", F.transform("v", lambda x: F.floor(F.lit(float(scale)) * x).cast("double")))
    once = rows.groupBy("id").agg(F.min(F.struct("label", "v")).alias("s")).select("id", "s.*")
    return once.withColumn("norm2", F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).withColumn("size", F.size("v"))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows id, label, v, norm2, size in order of size and falling norm, as buckets of one size."""
    held: dict[str, list] = {}

    def bucket() -> pa.RecordBatch:
        size = held["size"][0]
        data = np.concatenate(held["v"]).tobytes()
        ids, labels = (np.array(held[c], np.int64).tobytes() for c in ("id", "label"))
        columns = [pa.array([size], pa.int32()), pa.array([max(held["norm2"])], pa.float64()), *(pa.array([x], pa.binary()) for x in (ids, labels, data))]
        return pa.RecordBatch.from_arrays(columns, ["size", "norm2", "ids", "labels", "data"])

    for batch in batches:
        lists = batch.column(2)
        flat, offsets = lists.flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))))
        ids, labels, norms, sizes = (batch.column(i).to_pylist() for i in (0, 1, 3, 4))
        for i in range(batch.num_rows):
            if held and (sizes[i] != held["size"][0] or len(held["id"]) >= BUCKET):
                yield bucket()
                held = {}
            for name, x in (("id", ids[i]), ("label", labels[i]), ("v", flat[offsets[i] : offsets[i + 1]]), ("norm2", norms[i]), ("size", sizes[i])):
                held.setdefault(name, []).append(x)
    if held:
        yield bucket()


def buckets(vectors: DataFrame) -> DataFrame:
    """size, norm2 (the largest), place (a number without gaps in order of norm within a task's range), ids, labels, data."""
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = vectors.select("id", "label", "v", "norm2", "size").repartitionByRange(parts, "size", F.desc("norm2"), "id").sortWithinPartitions("size", F.desc("norm2"), "id")
    packed = ordered.mapInArrow(_packed, "size int, norm2 double, ids binary, labels binary, data binary")
    return materialise(packed.withColumn("place", F.monotonically_increasing_id()), "buckets")


class Best:
    """The k best (score, id) for each of n aims, as they come."""

    def __init__(self, n: int, k: int) -> None:
        self.k = k
        self.kth = np.full(n, _NONE)
        self.aim, self.score, self.id = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)

    def add(self, aim: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        aim, score, ids = np.concatenate((self.aim, aim)), np.concatenate((self.score, score)), np.concatenate((self.id, ids))
        order = np.lexsort((ids, -score, aim))
        aim, score, ids = aim[order], score[order], ids[order]
        starts = np.flatnonzero(np.concatenate(([True], aim[1:] != aim[:-1])))
        rank = np.arange(len(aim)) - np.repeat(starts, np.diff(np.concatenate((starts, [len(aim)]))))
        keep = rank < self.k
        self.aim, self.score, self.id = aim[keep], score[keep], ids[keep]
        last = rank == self.k - 1
        self.kth[aim[last]] = score[last]


def _offer(best: Best, aims: np.ndarray, scores: np.ndarray, allowed: np.ndarray, ids: np.ndarray) -> None:
    """Hand the allowed scores (one row for each aim) that can be among the best to ``best``."""
    scores = np.where(allowed, scores, _NONE)
    floor = best.kth[aims]
    if scores.shape[1] > best.k:
        floor = np.maximum(floor, np.partition(scores, scores.shape[1] - best.k, axis=1)[:, scores.shape[1] - best.k])
    i, j = np.nonzero((scores >= floor[:, None]) & (scores > _NONE))
    if len(i):
        best.add(aims[i], scores[i, j], ids[j])


def _bound(norms2: np.ndarray, norm2: float) -> np.ndarray:
    """What no score passes, a rounding error above the product of norms."""
    return np.sqrt(norms2 * norm2) * (1 + 1e-9)


def _positives(block: dict, stream: Iterator[tuple], k: int) -> tuple[list[str], list[np.ndarray]]:
    best = Best(len(block["id"]), k)
    for norm2, ids, labels, data in stream:
        on = np.flatnonzero(_bound(block["norm2"], norm2) >= best.kth)
        if not len(on):
            break
        same = (block["label"][on][:, None] == labels[None, :]) & (block["id"][on][:, None] != ids[None, :])
        _offer(best, on, block["data"][on] @ data.T, same, ids)
    return ["anchor_id", "other_id", "score"], [block["id"][best.aim], best.id, best.score.astype(np.int64)]


def _negatives(block: dict, stream: Iterator[tuple], k: int, window: tuple[int, int, int]) -> tuple[list[str], list[np.ndarray]]:
    """Aims are windows here: the block's positives, each with its anchor's place."""
    low, whole, high = window
    owner, score = block["owner"], block["positive_score"]
    best = Best(len(owner), k)
    lower = low * score / whole
    for norm2, ids, labels, data in stream:
        open_ = _bound(block["norm2"], norm2)[owner] >= np.maximum(best.kth, lower * (1 - 1e-9) - 1e-9)
        if not open_.any():
            break
        on, row = np.unique(owner[open_], return_inverse=True)
        scores = block["data"][on] @ data.T
        other = block["label"][on][:, None] != labels[None, :]
        aims = np.flatnonzero(open_)
        for at in range(0, len(aims), BLOCK):  # windows in parts, to hold few matrices at a time
            part, rows = aims[at : at + BLOCK], row[at : at + BLOCK]
            mine, limits = scores[rows], score[part][:, None]
            allowed = other[rows] & (whole * mine >= low * limits) & (whole * mine <= high * limits)
            _offer(best, part, mine, allowed, ids)
    return ["anchor_id", "positive_id", "positive_score", "other_id", "score"], [block["id"][owner[best.aim]], block["positive_id"][best.aim], score[best.aim], best.id, best.score.astype(np.int64)]


def _search(batches: Iterator[pa.RecordBatch], find) -> Iterator[pa.RecordBatch]:
    """Rows in order of block, size and stripe: first a block's anchors (kind 0), then its buckets; buckets of a size that no anchor has stand alone."""
    rows = (row for batch in batches for row in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns)), strict=True))
    row = next(rows, None)

    def stream(unit: tuple) -> Iterator[tuple]:
        nonlocal row
        while (row := next(rows, None)) is not None and row[:3] == unit and row[3] == 1:
            _, norm2, ids, labels, data, _ = row[4:]
            yield norm2, np.frombuffer(ids, np.int64), np.frombuffer(labels, np.int64), np.frombuffer(data).reshape(len(ids) // 8, -1)

    while row is not None:
        if row[3] == 1:
            row = next(rows, None)
            continue
        _, _, ids, labels, data, windows = row[4:]
        ids, rest = np.frombuffer(ids, np.int64), stream(row[:3])
        data = np.frombuffer(data).reshape(len(ids), -1)
        block = {"id": ids, "label": np.frombuffer(labels, np.int64), "data": data, "norm2": (data * data).sum(axis=1)}
        if windows is not None:
            windows = np.frombuffer(windows, np.int64).reshape(-1, 3)
            block |= {"owner": np.searchsorted(ids, windows[:, 0]), "positive_id": windows[:, 1], "positive_score": windows[:, 2]}
        names, columns = find(block, rest)
        for _ in rest:  # what the bounds rule out is passed over
            pass
        if len(columns[0]):
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c, np.int64)) for c in columns], names)


def _anchor_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows block, size, id, label, v, windows in order of block, size and id, as one row for each block and size: hashes of ids deal about BLOCK anchors to each."""
    held: list[tuple] = []

    def packed() -> pa.RecordBatch:
        ids, labels = (np.array([r[i] for r in held], np.int64).tobytes() for i in (2, 3))
        data = np.array([r[4] for r in held], np.float64).tobytes()
        windows = np.array([(r[2], w["other_id"], w["score"]) for r in held for w in r[5] or ()], np.int64).tobytes() if held[0][5] is not None else None
        columns = [pa.array([held[0][0]], pa.int64()), pa.array([held[0][1]], pa.int32()), *(pa.array([x], pa.binary()) for x in (ids, labels, data, windows))]
        return pa.RecordBatch.from_arrays(columns, ["block", "size", "ids", "labels", "data", "windows"])

    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
            if held and row[:2] != held[0][:2]:
                yield packed()
                held = []
            held.append(row)
    if held:
        yield packed()


def _meet(anchors: DataFrame, packed: DataFrame, find, schema: str, count: int) -> DataFrame:
    """Every block of anchors (id, label, v, size, windows) against every bucket of its size, by ``find``."""
    parts = int(packed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = -(-count // BLOCK)
    stripes = max(1, -(-2 * parts // blocks))
    dealt = anchors.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)))
    dealt = dealt.select("block", "size", "id", "label", "v", "windows").repartition(min(blocks, parts), "block").sortWithinPartitions("block", "size", "id")
    dealt = materialise(dealt.mapInArrow(_anchor_blocks, "block long, size int, ids binary, labels binary, data binary, windows binary"), "blocks")
    mine = dealt.select("block", "size", F.explode(F.sequence(F.lit(0), F.lit(stripes - 1))).alias("stripe"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("place"), F.lit(0.0).alias("norm2"), "ids", "labels", "data", "windows")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block")
    theirs = packed.select(every, "size", F.pmod("place", F.lit(stripes)).cast("int").alias("stripe"), F.lit(1).alias("kind"), "place", "norm2", "ids", "labels", "data", F.lit(None).cast("binary").alias("windows"))
    both = mine.unionByName(theirs).repartition(parts, "block", "size", "stripe").sortWithinPartitions("block", "size", "stripe", "kind", F.desc("norm2"), "place")
    return both.select("block", "stripe", "size", "kind", "place", "norm2", "ids", "labels", "data", "windows").mapInArrow(partial(_search, find=find), schema)


def _ranked(rows: DataFrame, by: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "other_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(
    table: DataFrame, anchors: Column, relabel: Column | None = None, positives: int = 5, negatives: int = 10, window: tuple[int, int, int] = (30, 100, 90), scale: float = 256.0, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label"
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    anchors and relabel are expressions over id (long) and label (long): which rows are anchors, and the
    label that counts. An anchor's positives are the best ``positives`` other rows of its label;
    each has the best ``negatives`` rows of other labels with low * positive_score <= whole *
    negative_score <= high * positive_score, for window = (low, whole, high). Fewer are
    returned where there are fewer, no row where there is none.

    Rows that take no part: see ``whole_vectors``. Vectors of different sizes have no score, so they never
    meet. An empty table, or one without anchors, gives no rows. Other columns stay outside.
    """
    vectors = whole_vectors(table, scale, vec_id, embedding, label)
    vectors = materialise(vectors.withColumn("label", relabel if relabel is not None else F.col("label")), "vectors")
    mine = vectors.where(anchors)
    count = max(1, mine.count())
    packed = buckets(vectors)
    near = _meet(mine.withColumn("windows", F.lit(None).cast("array<struct<other_id: long, score: long>>")), packed, partial(_positives, k=positives), "anchor_id long, other_id long, score long", count)
    near = materialise(_ranked(near, ["anchor_id"], positives), "positives")
    wanted = near.groupBy(F.col("anchor_id").alias("id")).agg(F.collect_list(F.struct("other_id", "score")).alias("windows"))
    far = _meet(mine.join(wanted, "id"), packed, partial(_negatives, k=negatives, window=window), "anchor_id long, positive_id long, positive_score long, other_id long, score long", count)
    out = _ranked(far, ["anchor_id", "positive_id"], negatives)
    forget(table.sparkSession)
    return out.select("anchor_id", "positive_id", "rank", F.col("other_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
