"""Quality by compression: two zstandard dictionaries, one of good and one of bad labelled text.

A text is compressed with either dictionary; the normalised difference of the two sizes says
which class it resembles, and a logistic calibration, with the compressed share of the text
beside that difference, turns it into a probability of label 1.

Learning reads a bounded sample: at most ``per_class`` labelled documents of either label, by
a hash of the id, the first half (by another hash) for the dictionaries and the rest for the
calibration, weighted back to the labels' own shares. Texts of any length teach, whole. Every
whole text is scored.

Null and empty texts are scored as empty. If one label is missing, there is nothing to
compare: the score is the share of label 1 (0.5 without any label). Several labels of one
document count as the smallest; null labels and documents without a row don't teach.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.llm.common import id_field, materialise, only, slices
from tabloom.sources.store import release

LEVEL = 3


@dataclass
class QualityModel:
    good: bytes
    bad: bytes
    weights: list[float]
    constant: float | None = None


#: Texts of either label that dictionaries need; below, all documents get the share of label 1.
LEAST = 8


class Scorer:
    """Features of texts, by the two dictionaries."""

    def __init__(self, good: bytes, bad: bytes):
        self.sides = []
        for raw in (good, bad):
            known = zstandard.ZstdCompressionDict(raw)
            known.precompute_compress(level=LEVEL)
            self.sides.append(zstandard.ZstdCompressor(dict_data=known, write_checksum=False, write_content_size=False, write_dict_id=False))

    def features(self, text: bytes) -> tuple[float, ...]:
        a, b = (len(side.compress(text)) for side in self.sides)
        n = len(text) + 16
        difference = (a - b) / (a + b)
        share = math.log((a + b + 16) / (2 * n))
        return (1.0, 10 * difference, 100 * difference * abs(difference), share, share * share, 10 * difference * share, math.log(n) / 10)


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weighted ridge logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    penalty = np.eye(x.shape[1]) * ridge
    penalty[0, 0] = 1e-9
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + penalty, x.T @ (weight * (y - p)) - penalty @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def dictionary(texts: list[bytes], dict_bytes: int) -> bytes:
    """A zstandard dictionary of texts; where they are too few or too short to train on, their own last bytes."""
    texts = sorted(t for t in texts if t)
    try:
        return zstandard.train_dictionary(dict_bytes, texts, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(texts)[-dict_bytes:]


def calibrated(good: bytes, bad: bytes, features: list[tuple[int, list[float]]], shares: dict[int, int]) -> QualityModel:
    """The model of two dictionaries whose features (label, values) of other texts are weighted to the labels' shares of all documents."""
    total = sum(shares.values())
    features = sorted(features)
    x, y = np.array([f for _, f in features]), np.array([q for q, _ in features], float)
    weight = np.where(y == 1, shares[1] / total / max(y.mean(), 1e-9), shares[0] / total / max(1 - y.mean(), 1e-9))
    return QualityModel(good, bad, _logistic(x, y, weight).tolist())


def fit(df: DataFrame, labels: DataFrame, learn_from: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_class: int = 3_000, dict_bytes: int = 112 << 10, sample_bytes: int = 64 << 20) -> QualityModel:
    """learn_from: a condition on df's rows. Labels are joined by id_col; of several texts under one id the least teaches.

    The sample has at most per_class documents of either label, of any length. Half of them
    make the dictionaries: of each label whole texts in a fixed order until they have
    sample_bytes, in a task of its own. The others are reduced to features where they lie. The driver gets
    two dictionaries and seven numbers for each of the others, whatever the lengths of texts. The
    sample's ids are bounded, so they are broadcast.
    """
    known = only(labels, id=id_col, q=label_col).where(F.col("q").isin(0, 1) & F.col("id").isNotNull()).groupBy("id").agg(F.min("q").alias("q"))
    teach = only(df.where(learn_from), id=id_col, text=text_col)
    ids = teach.select("id").distinct().join(known, "id")
    shares = {int(r.q): int(r.n) for r in ids.groupBy("q").agg(F.count("*").alias("n")).collect()}
    picked = None
    for label in (0, 1):
        part = ids.where(F.col("q") == label).orderBy(F.xxhash64("id"), "id").limit(per_class)
        picked = part if picked is None else picked.unionAll(part)
    rows = teach.join(F.broadcast(picked), "id").groupBy("id", "q").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    rows = materialise(rows.select("id", F.pmod(F.xxhash64("id", F.lit(7)), F.lit(2)).alias("half"), F.col("text").cast("binary").alias("text"), F.col("q").cast("int").alias("q")), "teachers")
    counts = {(int(r.half), int(r.q)): int(r.n) for r in rows.groupBy("half", "q").agg(F.count_if((F.col("half") == 1) | (F.octet_length("text") > 0)).alias("n")).collect()}
    if any(counts.get((0, q), 0) < LEAST or not counts.get((1, q)) for q in (0, 1)):
        return QualityModel(b"", b"", [], shares.get(1, 0) / sum(shares.values()) if shares else 0.5)
    before = F.sum(F.octet_length("text")).over(Window.partitionBy("q").orderBy(F.xxhash64("id"), "id").rowsBetween(Window.unboundedPreceding, -1))
    half = rows.where("half = 0").withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < sample_bytes).select("q", "text")

    def train(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = [t for batch in batches for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([dictionary(texts, dict_bytes)], pa.binary())], ["q", "raw"])

    raw = {r.q: bytes(r.raw) for r in half.groupBy("q").applyInArrow(train, "q int, raw binary").collect()}

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(raw[1], raw[0])
        for batch, texts in slices(batches, 4 << 20):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([list(scorer.features(t)) for t in texts], pa.list_(pa.float64()))], ["q", "f"])

    features = rows.where("half = 1").select("q", "text").mapInArrow(reduced, "q int, f array<double>").collect()
    release(rows)
    return calibrated(raw[1], raw[0], [(r.q, list(r.f)) for r in features], shares)


def score(df: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text", slice_bytes: int = 4 << 20) -> DataFrame:
    """Per row: the id and score, the probability of label 1."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model.good, model.bad) if model.constant is None else None
        weights = np.array(model.weights)
        for batch, texts in slices(batches, slice_bytes):
            if scorer is None:
                scores = np.full(len(texts), model.constant)
            else:
                z = np.array([scorer.features(t or b"") for t in texts]) @ weights
                scores = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=[id_col, "score"])

    return only(df, **{id_col: id_col, "__text": text_col}).mapInArrow(work, f"`{id_col}` {id_field(df, id_col)}, score double")
