"""Single-factor tables and columns of equal order, against the same rules in memory."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabloom.operators import binning, single
from tabloom.operators.single import SCORES

NUMBERS = ["wide", "gaps", "signs", "one", "none", "late"]


@pytest.fixture(scope="module")
def table(spark):
    rng, rows = random.Random(5), []
    for i in range(1_500):
        y = None if i % 41 == 0 else int(rng.random() < 0.2 + 0.5 * (i % 10 > 6))
        wide = rng.gauss(i % 10, 2)
        rows.append((i, i % 4 != 0, y, wide, None if i % 3 else wide, round(rng.gauss(0, 2), 1), 1.0, None, 3.0 if i % 4 == 0 else None, f"c{i % 10 // 2}" if i % 7 else None, f"x{i % 60}", None, "only" if i == 3 else f"r{i % 2}"))
    df = spark.createDataFrame(rows, "id int, tr boolean, y int, wide double, gaps double, signs double, one double, none double, late double, cat string, many string, empty string, rare string")
    return df, pd.DataFrame(rows, columns=df.columns)


def c_value(score: pd.Series, y: pd.Series) -> float | None:
    known = score.notna() & y.notna()
    x, t = score[known].rank(), y[known]
    n1, n0 = int((t > 0).sum()), int((t <= 0).sum())
    if n1 + n0 < 100 or not n1 or not n0:
        return None
    auc = (x[t > 0].sum() - n1 * (n1 + 1) / 2) / (n1 * n0)
    return max(auc, 1 - auc)


def numeric_scores(x: pd.Series) -> list[pd.Series]:
    low, high, least, most = *np.percentile(x, [5, 95]), x.min(), x.max()
    return [x, x.clip(low, high), np.sign(x) * np.log1p(np.abs(x)), np.exp(((x - least) / ((most - least) or 1)).clip(-5, 5)), x.rank(method="max") / len(x)]


def test_numbers(table):
    df, rows = table
    got = {r.variable: r for r in single.single_factors(df, NUMBERS, [], "y", F.col("tr"), ["id"]).collect()}
    assert set(got) == set(NUMBERS)
    train = rows[rows.tr]
    filled = df.where("tr")
    for c in ("wide", "gaps", "signs"):
        x = train[c].astype(float)
        assert got[c].fill == pytest.approx(x.median()) and got[c].missing == x.isna().sum() and got[c].result == "measured"
        for name, score in zip(SCORES, numeric_scores(x.fillna(x.median())), strict=True):
            assert got[c][name] == pytest.approx(c_value(score, train.y.astype(float))), (c, name)
        values = sorted(x.fillna(x.median()).value_counts().items())
        cuts = binning.equal_cuts([(float(v), int(n)) for v, n in values], 10)
        place = np.searchsorted(cuts, x.fillna(x.median()), side="left")
        t = train.y.astype(float)
        cells = pd.DataFrame({"b": place, "bad": (t > 0).astype(int), "good": (t <= 0).astype(int)}).groupby("b").sum()
        pb, pg = ((cells[k] + 0.5) / (cells[k].sum() + 0.5 * len(cells)) for k in ("bad", "good"))
        assert got[c].iv == pytest.approx(((pb - pg) * np.log(pb / pg)).sum()) and got[c].bins == len(cells)
    assert got["one"].result == got["none"].result == got["late"].result == "not measurable"
    assert got["one"].c_raw == 0.5 and got["one"].iv is None and got["none"].c_raw is None and got["late"].fill is None
    assert filled.count() == len(train) and not got["wide"].leak


def test_categories(table):
    df, rows = table
    got = {r.variable: r for r in single.single_factors(df, [], ["cat", "many", "empty", "rare"], "y", F.col("tr"), ["id"]).collect()}
    folds = dict(df.select("id", single.fold_of(["id"])).collect())
    train = rows[rows.tr].assign(f=lambda d: d.id.map(folds))
    for c in ("cat", "empty", "rare"):
        known = train.assign(v=train[c].fillna("MISSING")).dropna(subset=["y"])
        score = []
        for r in known.itertuples():
            rest = known[known.f != r.f]
            own = rest[rest.v == r.v]
            score.append((own if len(own) else rest).y.mean())
        assert got[c].c_raw == got[c].c_rank == pytest.approx(c_value(pd.Series(score, index=known.index).round(12), known.y.astype(float))), c
        assert got[c].missing == train[c].isna().sum() and got[c].bins == known.v.nunique()
    assert got["many"].result == "left out" and got["many"].c_raw is None and got["many"].iv is None


def test_leaks_small_and_empty_tables(spark, table):
    df, _ = table
    got = single.single_factors(df.withColumn("copy", F.col("y") + F.rand(1) / 100), ["copy"], ["rare"], "y", F.col("tr"), ["id"]).collect()
    assert [r.leak for r in got] == [True, False] and got[0].band == "güçlü"
    few = {r.variable: r for r in single.single_factors(df.where("id < 60"), ["wide"], ["rare"], "y", F.col("tr"), ["id"]).collect()}
    assert few["wide"].c_raw is None and few["rare"].c_raw is None
    assert single.single_factors(df.where("id < 0"), ["wide"], ["rare"], "y", F.col("tr"), ["id"]).count() == 0


def test_jobs_do_not_follow_the_variables(spark):
    from test_variables import jobs

    df = spark.range(400).select("id", (F.col("id") % 3 == 0).cast("int").alias("y"), *[F.rand(i).alias(f"v{i}") for i in range(60)])
    df.cache().count()
    run = lambda k: single.single_factors(df, [f"v{i}" for i in range(k)], [], "y", F.lit(True), ["id"]).collect()
    assert jobs(spark, lambda: run(60)) <= jobs(spark, lambda: run(2)) + 4


def test_same_order(spark, table):
    df, _ = table
    swapped = F.when(F.col("id") == 5, 7).when(F.col("id") == 7, 5).otherwise(F.col("id"))
    made = {
        "a": F.col("wide"), "b": F.exp("wide"), "c": -F.col("wide") * 3, "d": F.col("gaps"), "e": F.coalesce("gaps", F.lit(0.0)), "f": F.col("gaps") + 5,
        "g": F.col("id") * 1.0, "h": swapped, "i": F.lit(1), "j": F.lit(2), "k": F.col("none"), "l": F.round("wide", 1), "m": F.col("late"), "n": F.when(~F.col("tr"), 8),
    }
    wide = df.repartition(5).select("id", *[v.alias(k) for k, v in made.items()])
    got = {r.column: (r.first, r.direction) for r in single.same_order(wide, list(made), ["id"]).collect()}
    assert got == {"a": ("a", "same"), "b": ("a", "same"), "c": ("a", "opposite"), "d": ("d", "same"), "f": ("d", "same"), "i": ("i", "same"), "j": ("i", "same"), "m": ("m", "same"), "n": ("m", "same")}
    assert single.same_order(wide.where("id < 0"), list(made), ["id"]).count() == 0
