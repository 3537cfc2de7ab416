"""Rolling medians against the definition, on odd rows and on the given clicks."""

from __future__ import annotations

import random
from datetime import datetime, timedelta
from statistics import median

import numpy as np
import oracle
import pytest
from pyspark.sql import functions as F
from tabloom.llm import queries, rolling

SCHEMA = "click_id long, ts timestamp_ntz, kind string, value double, n string, at string, series string"


def naive(rows):
    """click_id -> (kind, n, median2, mad4, far)."""
    once = {}
    for i, t, kind, v, *_ in rows:
        if t is not None:
            key = (t, kind is not None, kind or "", v is not None, v or 0.0)
            if i not in once or key < once[i][0]:
                once[i] = key, (t, kind, v)
    cents = {i: None if v is None or not np.isfinite(v) else int(np.floor(100 * v + 0.5)) for i, (_, (_, _, v)) in once.items()}
    out = {}
    for i, (_, (t, kind, _)) in once.items():
        x = [cents[j] for j, (_, (u, k, _)) in once.items() if k == kind and t - timedelta(minutes=15) < u <= t and cents[j] is not None]
        if not x:
            out[i] = kind, 0, None, None, None
            continue
        m = round(2 * median(x))
        d = round(2 * median([abs(2 * c - m) for c in x]))
        out[i] = kind, len(x), m, d, None if cents[i] is None else 2 * abs(2 * cents[i] - m) > 2 * d
    return out


def got(df):
    return {r.click_id: (r.kind, r.n, r.median2, r.mad4, r.far) for r in df.collect()}


@pytest.fixture(scope="module")
def clicks():
    rng, start, rows = random.Random(5), datetime(2023, 12, 31, 23, 50), []
    for i in range(700):
        t = start + timedelta(microseconds=rng.choice([0, 1, 900_000_000, 900_000_001, 1_800_000_000, rng.randrange(12_000_000_000)]))
        v = rng.choice([None, 0.0, 1.005, -3.5, float("nan"), float("inf"), rng.uniform(-5, 5), rng.expovariate(0.01), 4e5])
        rows.append((i, None if i % 50 == 7 else t, rng.choice(["a", "a", "a", "b", None]), v, "x", "y", "z"))
    rows += [rows[3], rows[3], (3, datetime(2024, 2, 1), "b", 1.0, "", "", ""), (None, start, "a", 2.0, "", "", ""), (None, None, None, None, None, None, None)]
    rows.append((9_000, datetime(1969, 12, 31, 23, 59, 59, 999_999), "old", 1.0, "", "", ""))
    rows.append((9_001, datetime(1970, 1, 1, 0, 14, 59, 999_998), "old", 2.0, "", "", ""))
    return rows


def test_definition(spark, clicks):
    df = spark.createDataFrame(clicks, SCHEMA).repartition(5)
    assert got(rolling.rolling_far(df)) == naive(clicks)


def test_zone_of_the_session_plays_no_part(spark, clicks):
    try:
        spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
        assert got(rolling.rolling_far(spark.createDataFrame(clicks, SCHEMA))) == naive(clicks)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_stretches_and_hot_times(spark, clicks, monkeypatch):
    """Cells of any size against stretches of few points; a third of all clicks at one time, more than is left to a join."""
    monkeypatch.setattr(rolling, "STRETCH", 3)
    hot = [(20_000 + i, datetime(2024, 1, 5, 3), "hot", float(i % 7), "", "", "") for i in range(1_500)]
    rows = [*clicks, *hot]
    found = got(rolling.rolling_far(spark.createDataFrame(rows, SCHEMA)))
    want = naive(clicks)
    assert {k: v for k, v in found.items() if k is None or k < 20_000} == want
    # values 0 to 6, as good as equally often: the median is 3, the median distance from it 2, the farthest 3
    assert {v for k, v in found.items() if k and k >= 20_000} == {("hot", 1_500, 600, 800, False)}


def test_empty_and_short_windows(spark, clicks):
    df = spark.createDataFrame(clicks, SCHEMA)
    assert rolling.rolling_far(df.limit(0)).count() == 0
    assert rolling.rolling_far(df.where("ts IS NULL")).count() == 0
    assert {r.n for r in rolling.rolling_far(df.where("value IS NULL")).collect()} == {0}
    with pytest.raises(ValueError):
        rolling.rolling_far(df, minutes=60 * 24 * 60)


def test_medians_of_weighted_values():
    rng = np.random.default_rng(1)
    for _ in range(150):
        n = int(rng.integers(1, 50))
        v, w = (rng.integers(-40, 50, n) * rng.choice([1, 1, 1_000_003])).astype(np.int64), rng.integers(1, 4, n)
        ends = np.sort(rng.integers(0, n + 1, (20, 2)), axis=1)
        for (left, right), *found in zip(ends, *rolling.medians(v, w, ends[:, 0], ends[:, 1]), strict=True):
            x = np.repeat(v[left:right], w[left:right])
            m = round(2 * median(x.tolist())) if len(x) else 0
            assert found == [len(x), m, round(2 * median(np.abs(2 * x - m).tolist())) if len(x) else 0]


def test_query_against_sql(spark, small):
    con = oracle.connect(small)
    assert oracle.differences(queries.op12_rolling_median(spark, small), con, queries.oracle_sql()["op12_rolling_median"]) == []


def test_units(spark):
    row = spark.sql("SELECT 1.005D AS a, -0.005D AS b, 1e300D AS c, double('nan') AS d").select(*[rolling.units(F.col(c)) for c in "abcd"]).first()
    assert list(row) == [100, 0, rolling.BOUND, None]
