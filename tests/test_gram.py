"""Correlations of all pairs against the pairwise definition."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabloom.operators import checks, gram, select


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(1e6, 1, (700, 23))
    x[:, 3] = 2 * x[:, 2] + 5
    x[:, 4] = -x[:, 2] + rng.normal(0, 0.01, 700)
    x[rng.random(x.shape) < 0.2] = np.nan
    x[:, 7], x[:, 8] = 4.0, np.nan
    x[1:, 9] = np.nan
    pdf = pd.DataFrame(x, columns=[f"a b{i}" for i in range(23)])
    return spark.createDataFrame(pdf).repartition(5), pdf


def naive(pdf, least=0.0):
    out = {}
    for i, a in enumerate(pdf.columns):
        for b in pdf.columns[i + 1 :]:
            both = pdf[[a, b]].dropna()
            if len(both) > 1 and both[a].std() > 1e-5 and both[b].std() > 1e-5:
                r = both[a].corr(both[b])
                if abs(r) >= least:
                    out[a, b] = len(both), r
    return out


@pytest.mark.parametrize(("tile", "panel"), [(128, 1024), (4, 1024), (3, 6), (5, 10)])
def test_pairs(table, monkeypatch, tile, panel):
    df, pdf = table
    monkeypatch.setattr(gram, "TILE", tile)
    monkeypatch.setattr(gram, "PANEL", panel)
    rows = gram.correlations(df, pdf.columns).collect()
    got = {(r.a, r.b): (r.n, r.r) for r in rows}
    want = naive(pdf)
    assert len(rows) == len(got) and set(got) == set(want)
    for k, (n, r) in want.items():
        assert got[k][0] == n and got[k][1] == pytest.approx(r, abs=1e-7)
    assert {(r.a, r.b) for r in gram.correlations(df, pdf.columns, 0.99).collect()} == set(naive(pdf, 0.99)) == {("a b2", "a b3"), ("a b2", "a b4"), ("a b3", "a b4")}


def test_nothing_to_pair(spark, table):
    df, _ = table
    assert gram.correlations(df, ["a b1"]).count() == gram.correlations(df, ["a b1", "a b1"]).count() == 0
    assert gram.correlations(df.limit(0), ["a b1", "a b2"]).count() == 0
    texts = spark.createDataFrame([("1", 2.0), ("x", 3.0), ("3", float("inf")), ("4", 9.0), ("7", 1.0)], "a string, b double")
    r = gram.correlations(texts, ["a", "b"]).first()
    assert r.n == 3 and r.r == pytest.approx(np.corrcoef([1, 4, 7], [2, 9, 1])[0, 1])


def test_selection_of_hundreds(spark):
    """300 columns, a third of them copies up to a factor: the priority decides which stay."""
    df = spark.range(400).select(*[F.rand(i).alias(f"c{i}") for i in range(200)])
    df = df.select("*", *[(F.col(f"c{i}") * (i + 2)).alias(f"d{i}") for i in range(100)]).cache()
    names = df.columns
    gone = select.prune_correlated(select.correlations(df, names, 0.95), {f"d{i}": 1.0 for i in range(0, 100, 2)})
    assert gone == {(f"c{i}" if i % 2 == 0 else f"d{i}"): (f"d{i}" if i % 2 == 0 else f"c{i}") for i in range(100)}


def test_near_copies_of_one_signature(spark):
    """Many copies in one bucket; multiples are told from mere correlation."""
    df = spark.range(300).withColumn("x", F.rand(1) + 1).select(*[(F.col("x") * k).alias(f"m{k}") for k in (1, 2, 3, 4)], (F.col("x") + F.rand(2) * 1e-4).alias("near"), F.rand(9).alias("other")).cache()
    got = {(r.column, r["copy"]): r.relation for r in checks.near_copies(df, df.columns).collect()}
    assert got == {**{(f"m{a}", f"m{b}"): "kat" for a in (1, 2, 3, 4) for b in range(a + 1, 5)}, **{(f"m{a}", "near"): "kor" for a in (1, 2, 3, 4)}}
