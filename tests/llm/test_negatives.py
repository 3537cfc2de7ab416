"""Hard negatives against the definition."""

from __future__ import annotations

import math
import random
from collections import defaultdict

import oracle
import pytest
from pyspark.sql import functions as F
from tabloom.llm import negatives, queries

SCHEMA = "vec_id long, embedding array<float>, label int, id string, v string, norm2 string"


def naive(rows, anchor, positives=5, count=10, window=(30, 100, 90), scale=256.0):
    """Rows of (anchor, positive, rank, negative, positive score, negative score)."""
    low, whole, high = window
    v = {i: (label, [math.floor(scale * x) for x in e]) for i, e, label, *_ in rows if i is not None and label is not None and e and all(x is not None and math.isfinite(x) for x in e)}
    out = set()
    for i, (label, e) in v.items():
        if not anchor(i):
            continue
        met = sorted((-sum(a * b for a, b in zip(e, x, strict=True)), j, other == label) for j, (other, x) in v.items() if j != i and len(x) == len(e))
        for p, j, _ in [m for m in met if m[2]][:positives]:
            fit = [m for m in met if not m[2] and low * -p <= whole * -m[0] <= high * -p][:count]
            out |= {(i, j, r, m[1], -p, -m[0]) for r, m in enumerate(fit, 1)}
    return out


def got(df):
    rows = [tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.fixture(scope="module")
def vectors():
    """Norms from none to large, ties, one vector many times over, another size, broken rows."""
    rng = random.Random(8)
    f32 = lambda x: round(x * 64) / 64  # noqa: E731  exact as a 32-bit number
    rows = [(i, [f32(rng.gauss(0, 1) * rng.choice([0, 0.1, 1, 1, 5])) for _ in range(6)], rng.randrange(3)) for i in range(400)]
    rows += [(400 + i, rows[7][1], i % 3) for i in range(120)]
    rows += [(600 + i, [f32(rng.gauss(0, 1)) for _ in range(4)], i % 2) for i in range(30)]
    rows += [(700, None, 1), (710, [], 1), (720, [1.0, None, 1.0, 1.0, 1.0, 1.0], 1), (730, [float("nan")] * 6, 1), (740, [float("inf")] * 6, 1), (750, [1.0] * 6, None), (None, [1.0] * 6, 1)]
    rows += [(-10, [1.0] * 6, 1), (760, [0.0] * 6, 0)]
    return [(*r, "a", "b", "c") for r in rows]


def test_definition(spark, vectors):
    df = spark.createDataFrame([*vectors, vectors[10], vectors[10]], SCHEMA).repartition(3)
    found = got(negatives.hard_negatives(df, F.col("id") % 10 == 0))
    assert found == naive(vectors, lambda i: i % 10 == 0)
    assert len(found) > 500


def test_small_buckets_and_blocks(spark, vectors, monkeypatch):
    monkeypatch.setattr(negatives, "BUCKET", 7)
    monkeypatch.setattr(negatives, "BLOCK", 5)
    df = spark.createDataFrame(vectors, SCHEMA)
    found = got(negatives.hard_negatives(df, F.col("id") % 4 == 0, positives=2, negatives=3, window=(-50, 100, 100)))
    assert found == naive(vectors, lambda i: i % 4 == 0, 2, 3, (-50, 100, 100))


def test_bounds_pass_over_short_vectors(vectors):
    """Once the kth score is above the product of norms, nothing more is read."""
    import numpy as np

    read = []

    def stream():
        for norm in (10.0, 9.0, 1.0, 0.5):
            read.append(norm)
            data = np.array([[norm, 0.0]] * 3)
            yield norm * norm, np.arange(3) + int(norm * 10), np.ones(3, np.int64), data

    block = {"id": np.array([1]), "label": np.array([1]), "data": np.array([[2.0, 0.0]]), "norm2": np.array([4.0])}
    _, (anchor, other, score) = negatives._positives(block, stream(), 4)
    assert (list(other), list(score), read) == ([100, 101, 102, 90], [20, 20, 20, 18], [10.0, 9.0, 1.0])
    read.clear()
    windows = {"owner": np.array([0]), "positive_id": np.array([5]), "positive_score": np.array([10])}
    block |= {"label": np.array([2])} | windows
    _, columns = negatives._negatives(block, stream(), 2, (30, 100, 180))
    assert (list(columns[3]), read) == ([90, 91], [10.0, 9.0, 1.0])


def test_empty(spark, vectors):
    df = spark.createDataFrame(vectors, SCHEMA)
    assert negatives.hard_negatives(df.limit(0), F.col("id") % 10 == 0).count() == 0
    assert negatives.hard_negatives(df, F.lit(False)).count() == 0
    assert negatives.hard_negatives(df.where("vec_id < 4 AND label = 0"), F.lit(True)).count() == 0


def test_query_against_sql(spark, small):
    con = oracle.connect(small)
    assert oracle.differences(queries.op11_hard_negatives(spark, small), con, queries.oracle_sql()["op11_hard_negatives"]) == []
    by = defaultdict(list)
    for r in queries.op11_hard_negatives(spark, small).collect():
        by[r.anchor_id, r.positive_id].append(r.rank)
    assert all(sorted(x) == list(range(1, len(x) + 1)) for x in by.values())
