"""Mutual information by nearest neighbours, against all distances in memory."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from tabloom.operators import measures, neighbours


def harmonic(n: int) -> float:
    """digamma of a whole number, by its definition."""
    return -0.57721566490153286 + math.fsum(1 / i for i in range(1, n))


def brute(pairs: list[tuple[float, bool]], k: int) -> tuple[int, float]:
    sizes = {c: sum(1 for _, y in pairs if y == c) for c in (True, False)}
    kept = [(x, y) for x, y in pairs if sizes[y] > 1]
    if len({y for _, y in kept}) < 2:
        return len(kept), 0.0
    terms = []
    for i, (x, y) in enumerate(kept):
        near = sorted(abs(x - v) for j, (v, z) in enumerate(kept) if j != i and z == y)
        r = near[min(k, len(near)) - 1]
        same = sum(1 for v, z in kept if v == x and z == y)
        within = sum(1 for v, _ in kept if x - r < v < x + r) if r > 0 else sum(1 for v, _ in kept if v == x)
        terms.append(harmonic(min(k, len(near)) if r > 0 else same) - harmonic(sizes[y]) - harmonic(within))
    return len(kept), max(0.0, harmonic(len(kept)) + math.fsum(terms) / len(kept))


def test_digamma(spark):
    got = spark.range(1, 400).select("id", neighbours.digamma(F.col("id")).alias("d")).collect()
    assert all(r.d == pytest.approx(harmonic(r.id), abs=1e-11) for r in got)


@pytest.fixture(scope="module")
def rows() -> list[tuple]:
    rng, found = random.Random(9), []
    for i in range(500):
        y = None if i % 71 == 0 else int(rng.random() < 0.3)
        found.append((y, rng.gauss(2.0 * (y or 0), 1), rng.random(), None if i % 5 == 0 else float(rng.randint(0, 6) + 3 * (y or 0)), math.nan if i % 9 == 0 else math.inf if i % 11 == 0 else rng.gauss(0, 1), 4.0))
    return found


NAMES = ["told", "noise", "ties", "broken", "same"]
SCHEMA = "y int, told double, noise double, ties double, broken double, same double"


@pytest.mark.parametrize("k,block", [(3, 16_384), (3, 8), (5, 10), (1, 2)])
@pytest.mark.parametrize("small", [1 << 40, 0])
def test_brute_force(spark, rows, monkeypatch, k, block, small):
    """Blocks far smaller than the columns, ranges instead of one window: the same figures."""
    if small == 0 and k == 5:
        pytest.skip("one case of ranges is enough for each kind of block")
    monkeypatch.setattr(measures, "SMALL", small)
    got = {r.variable: (r.rows, r.mi) for r in neighbours.information(spark.createDataFrame(rows, SCHEMA), NAMES, "y", k, block).collect()}
    assert set(got) == set(NAMES)
    for at, name in enumerate(NAMES, 1):
        pairs = [(r[at] if r[at] is not None and math.isfinite(r[at]) else 0.0, (r[0] or 0) > 0) for r in rows]
        n, mi = brute(pairs, k)
        assert got[name] == (n, pytest.approx(mi, abs=1e-9)), name
    assert got["told"][1] > 0.2 > 0.1 > got["noise"][1] and got["same"][1] == pytest.approx(0.0, abs=1e-9)


def test_small_classes(spark):
    """Fewer rows of a class than k neighbours; a class of one row; one class; no rows; repeated and clashing names."""
    few = [(1, 0.0), (1, 2.0), (0, 1.0), (0, 5.0), (0, 9.0), (0, 9.5), (0, 11.0)]
    df = lambda rows: spark.createDataFrame(rows, "y int, n double")
    got = neighbours.information(df(few), ["n", "n"], "y").collect()
    assert len(got) == 1 and (got[0].rows, got[0].mi) == (7, pytest.approx(brute([(x, y > 0) for y, x in few], 3)[1]))
    for rows, kept in ((few[1:], 5), (few[2:], 5), ([], 0)):
        assert [tuple(r) for r in neighbours.information(df(rows), ["n"], "y").collect()] == [("n", kept, 0.0)]
    with pytest.raises(ValueError):
        neighbours.information(df(few), [], "y")


def test_number_of_jobs_ignores_columns(spark, rows):
    def jobs(names: list[str]) -> int:
        tag = f"neighbours-{len(names)}"
        spark.sparkContext.setJobGroup(tag, tag)
        neighbours.information(spark.createDataFrame(rows[:60], SCHEMA), names, "y")
        found = len(spark.sparkContext.statusTracker().getJobIdsForGroup(tag))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return found

    assert jobs(NAMES) <= jobs(NAMES[:2]) + 2
