"""What candidates add, against fits of one candidate at a time in memory."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabloom.operators import features, uplift

from test_variables import jobs


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(2)
    n = 1_500
    a, b = rng.normal(0, 1, n), rng.exponential(1, n)
    y = (rng.random(n) < 1 / (1 + np.exp(-(a * a - 1 + 0.7 * b)))).astype(float)
    pdf = pd.DataFrame({"id": np.arange(n), "y": y, "a": a, "b": np.where(rng.random(n) < 0.1, np.nan, b), "few": rng.integers(0, 4, n).astype(float), "zero": np.where(rng.random(n) < 0.6, 0.0, a)})
    pdf.loc[::40, "y"] = np.nan
    pdf["a__KARE"], pdf["a__ISR"], pdf["b__KARE"], pdf["same"], pdf["sum"], pdf["half"] = pdf.a**2, np.sign(pdf.a), pdf.b**2, pdf.a * 3 + 1, pdf.a**2 + pdf.b, np.where(pdf.id % 50 == 0, pdf.a, np.nan)
    pdf["none"], pdf["one"] = np.nan, 1.0
    return spark.createDataFrame(pdf).select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if c != "id" else F.col(c) for c in pdf.columns]).cache(), pdf


def naive_iv(x, y):
    d = x.dropna().unique()
    if not len(d):
        return None
    if len(d) <= 10:
        code = x.fillna(-1e9)
    else:
        code = pd.Series(np.searchsorted(np.unique(np.quantile(x.dropna(), np.arange(1, 10) / 10)), x.fillna(0), side="left"), x.index).where(x.notna(), -1)
    g = y.groupby(code).agg(["sum", "size"])
    bad, good = g["sum"], g["size"] - g["sum"]
    p, q = (bad + 0.5) / (bad.sum() + 0.5 * len(g)), (good + 0.5) / (good.sum() + 0.5 * len(g))
    return float(((p - q) * np.log(p / q)).sum())


def naive_auc(score, y):
    r = pd.Series(score).rank()
    n1 = y.sum()
    return (r[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(y) - n1))


def naive_fit(x, y):
    design = np.column_stack([np.ones(len(x)), x])
    b = np.zeros(design.shape[1])
    b[0] = np.log(y.mean() / (1 - y.mean()))
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(design @ b, -30, 30)))
        step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + 1e-8 * np.eye(len(b)), design.T @ (y - p))
        b += step
        if np.abs(step).max() < 1e-4:
            break
    return b


def naive_gain(pdf, source, candidate):
    rows = pdf[[source, candidate, "y", "h"]].dropna()
    if len(rows) < 50 or rows[source].std() == 0 or rows[candidate].std() == 0:
        return None
    z = rows[[source, candidate]]
    z = ((z - z.mean()) / z.std(ddof=0)).to_numpy()
    y, h = rows.y.to_numpy(), rows.h.to_numpy()
    auc = {1: [], 2: []}
    for half in (0, 1):
        for k in (1, 2):
            b = naive_fit(z[h != half, :k], y[h != half])
            auc[k].append(naive_auc(b[0] + z[h == half, :k] @ b[1:], y[h == half]))
    gain = np.mean(auc[2]) - max(np.mean(auc[1]), 0.5)
    error = np.sqrt((len(y) + 1) / (12 * y.sum() * (len(y) - y.sum())))
    return 0.0 if 0 < gain < 2 * error else gain


CANDIDATES = {"a__KARE": ["a"], "a__ISR": ["a"], "b__KARE": ["b"], "same": ["a"], "sum": ["a", "b"], "half": ["a"], "none": ["a"], "one": ["a"], "few": [], "zero": ["a"]}


def test_measure(spark, table):
    df, pdf = table
    halves = dict(df.select("id", features.fold_of(["id"], 2)).collect())
    rows = pdf[pdf.y.notna()].assign(h=pdf.id.map(halves))
    got = {r.column: r for r in uplift.measure(df, CANDIDATES, "y", ["id"], [c for c, s in CANDIDATES.items() if len(s) == 1]).collect()}
    assert list(got) == list(CANDIDATES)
    for c, sources in CANDIDATES.items():
        r, iv = got[c], naive_iv(rows[c], rows.y)
        assert r.iv == (None if iv is None else pytest.approx(iv)), c
        best = max((naive_iv(rows[s], rows.y) for s in sources), default=None)
        assert r.source_iv == (None if best is None else pytest.approx(best))
        if iv is not None and iv - (best or 0) >= 0.02 and sources:
            want = []
            for s in sources:
                both = rows[[c, s]].notna().all(axis=1)
                want.append(abs(np.corrcoef(rows[c].rank()[both], rows[s].rank()[both])[0, 1]))
            assert r.rho == pytest.approx(max(want)), c
        else:
            assert r.rho is None
        if len(sources) == 1:
            gain = naive_gain(rows, sources[0], c)
            assert r.linear_gain == (None if gain is None else pytest.approx(gain, abs=1e-6)), c
    assert got["a__KARE"].worth and got["sum"].worth and not got["same"].worth and not got["none"].worth and got["a__KARE"].linear_gain > 0.1


def test_passes_do_not_follow_the_candidates(spark, table):
    df, _ = table
    more = df.select("*", *[(F.col("a") * F.col("a") + F.rand(i)).alias(f"v{i}") for i in range(40)]).cache()
    few = jobs(spark, lambda: uplift.linear_gains(more, [("v0", "a")], "y", ["id"]))
    many = jobs(spark, lambda: uplift.linear_gains(more, [(f"v{i}", "a") for i in range(40)], "y", ["id"]))
    assert many <= few + 6


def test_measured_once(spark, table):
    df, _ = table
    memo = uplift.Measured()
    first = uplift.measure(df, {"same": ["a"]}, "y", ["id"], measured=memo).collect()
    assert jobs(spark, lambda: uplift.measure(df, {"same": ["a"]}, "y", ["id"], measured=memo)) == 0
    assert uplift.measure(df, {"same": ["a"]}, "y", ["id"], measured=memo).collect() == first and len(memo.known) == 1
    uplift.measure(df.where("id < 700"), {"same": ["a"]}, "y", ["id"], measured=memo)
    assert len(memo.known) == 2


def test_no_rows(spark, table):
    r = uplift.measure(table[0].limit(0), {"same": ["a"]}, "y", ["id"], ["same"]).first()
    assert (r.iv, r.gain, r.linear_gain, r.worth) == (None, None, None, False)
