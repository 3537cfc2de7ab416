"""Bins of many variables at once, against the same rules applied to one variable's rows in memory."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabloom.functions.joins import attach
from tabloom.operators import binning, measures, remedies, variables
from tabloom.operators.binning import Bin


def jobs(spark, work) -> int:
    """Jobs of the whole session while work runs, those of broadcasts included."""
    started = spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs
    before = started()
    work()
    return started() - before


@pytest.fixture(scope="module")
def table(spark):
    """Columns of every kind: many values, few, heavy ones between light ones, gaps, one value, none."""
    rng, rows = random.Random(3), []
    for i in range(3_000):
        y = None if i % 97 == 0 else int(rng.random() < 0.2 + 0.5 * (i % 10 > 6))
        fine, heavy = rng.gauss(i % 10, 2), float(rng.choice([0, 0, 0, 5, rng.randrange(100), rng.random()]))
        rows.append((i, ("train", "train", "test", "oot", None)[i // 10 % 5], y, fine, heavy, float(i % 7), None if i % 3 else fine, 1.0, None, abs(i % 10 - 5) + rng.random(), f"c{i % 10 // 2}", f"x{i}", None if i % 4 == 0 else "only", " a " if i % 2 else None))
    names = ["fine", "heavy", "few", "gaps", "one", "none", "curve"]
    df = spark.createDataFrame(rows, "id int, s string, y int, fine double, heavy double, few double, gaps double, one double, none double, curve double, cat string, ids string, flag string, YAS_GRUBU string")
    return df, pd.DataFrame(rows, columns=df.columns), names


def test_cuts_and_jobs(spark, table):
    df, rows, names = table
    train = rows[(rows.s == "train") & rows.y.notna()]
    for bins in (20, 10, 3):
        run = measures.cumulate(variables.value_counts(df, names, "y", F.col("s"), False).where("s = 'train' AND v IS NOT NULL"), ["k"], "v", ["n"]).withColumn("upto", F.col("n_before") + F.col("n")).cache()
        cuts = variables.equal_cuts(run, bins)
        for c in names:
            counts = sorted(Counter(train[c].dropna()).items())
            assert cuts.get(c, []) == binning.equal_cuts(counts, bins), (c, bins)


def test_jobs_do_not_follow_the_variables(spark):
    df = spark.range(400).select(F.when(F.col("id") % 2 == 0, "train").otherwise("test").alias("s"), (F.col("id") % 3 == 0).cast("int").alias("y"), *[F.rand(i).alias(f"v{i}") for i in range(120)])
    df.cache().count()
    few = jobs(spark, lambda: variables.proposals(df, ["v0", "v1"], [], "y", F.col("s")).collect())
    many = jobs(spark, lambda: variables.proposals(df, [f"v{i}" for i in range(120)], [], "y", F.col("s")).collect())
    assert many <= few + 4 and many <= 40


def test_proposals(spark, table):
    df, rows, names = table
    got = {r.variable: r for r in variables.proposals(df, names, ["cat", "ids", "flag", "YAS_GRUBU"], "y", F.col("s"), {"cat": "müşterinin dini ve cinsiyeti (GENDER)"}).collect()}
    assert set(got) == {*names, "cat", "ids", "flag", "YAS_GRUBU"}
    used = rows[rows.y.notna() & rows.s.notna()]
    train = used[used.s == "train"]
    for c in names:
        filled, r = train[train[c].notna()], got[c]
        if len(filled) < 100:
            assert (r.bins, r.note) == (0, "too few rows or one class")
            continue
        cuts = binning.equal_cuts(sorted(Counter(filled[c]).items()), 20)
        place = lambda x: sum(k < x for k in cuts)  # noqa: E731, B023
        fine = [Bin(len(g), int(g.y.sum()), high=cuts[b] if b < len(cuts) else None, values=(b,)) for b, g in sorted(filled.groupby(filled[c].map(place)))]
        bins, shape = binning.best_bins(fine, len(train))
        if len(bins) > 1 and binning.iv(bins) < 0.02:
            bins, shape = [Bin(len(filled), int(filled.y.sum()))], "düz"
        assert (r.shape, r.n, r.bad, r.cuts) == (shape, [b.n for b in bins], [b.bad for b in bins], [b.high for b in bins[:-1]]), c
        gone = train[train[c].isna()]
        shown = [*bins, Bin(len(gone), int(gone.y.sum()))] if len(gone) else bins
        assert r.n_missing == len(gone) and r.iv == pytest.approx(binning.iv(shown))
        for s in ("test", "oot"):
            other = used[(used.s == s) & used[c].notna()]
            g = other.groupby(other[c].map(lambda x: sum(k < x for k in r.cuts))).y.agg(["size", "mean"])  # noqa: B023
            if len(bins) > 1 and len(g) == len(bins) and (g["size"] >= 30).all():
                assert r.consistency[s] == pytest.approx(pd.Series([b.rate for b in bins]).rank().corr(g["mean"].reset_index(drop=True).rank()), abs=1e-3)
            else:
                assert s not in r.consistency
        if len(gone):
            assert r.median == filled[c].median() and r.median_bin == sum(k < r.median for k in r.cuts)
    assert got["fine"].bins > 1 and got["curve"].shape in ("U", "ters U", "artan", "azalan") and got["fine"].consistency
    assert got["ids"].note == "over 200 levels" and got["ids"].bins == 0
    assert sorted(v for b in got["cat"].levels for v in b) == [f"c{i}" for i in range(5)] and got["cat"].shape == "gruplama"
    assert got["cat"].sensitive in ("din", "cinsiyet") and got["YAS_GRUBU"].sensitive == "yaş" and got["fine"].sensitive is None
    assert got["flag"].n_missing == train.flag.isna().sum()


def test_proposals_of_no_rows(spark, table):
    assert variables.proposals(table[0].limit(0), ["fine"], ["cat"], "y", F.col("s")).count() == 0


def naive_groups(rows: list[tuple], rare: int) -> dict[str, str]:
    seen = defaultdict(lambda: [0, 0])
    for c, y in rows:
        if y is not None:
            key = "Boş" if c is None else c.strip()
            seen[key][0] += 1
            seen[key][1] += y > 0
    common = [Bin(n, b, values=(c,)) for c, (n, b) in seen.items() if n >= rare]
    few = [(c, n, b) for c, (n, b) in seen.items() if n < rare]
    if few:
        common.append(Bin(sum(n for _, n, _ in few), sum(b for _, _, b in few), values=("Seyrek",)))
    order = sorted(common, key=lambda b: (b.rate, -b.n, b.values))
    merged = binning._distinct(binning._shares(order, sum(b.n for b in order)))
    out = {v: f"G{i + 1}" for i, b in enumerate(merged) for v in b.values}
    return {c: out.get(c, out.get("Seyrek")) for c in seen} | {"?": out.get("Seyrek") or out[max(merged, key=lambda b: b.n).values[0]]}


@pytest.mark.parametrize("rare", [1, 30])
def test_target_groups(spark, rare):
    rng = random.Random(rare)
    rows = [(rng.choice([None, " a", "a ", *[f"k{j}" for j in range(40)]]) if rng.random() < 0.9 else f"r{i}", rng.choice([None, 0, 0, 1])) for i in range(2_500)]
    want = naive_groups(rows, rare)
    df = spark.createDataFrame(rows, "c string, y int")
    groups = variables.target_groups(df, "c", "y", rare)
    assert {r.category: r.grp for r in groups.collect()} == {c: g for c, g in want.items() if c != "?"}
    marked = variables.with_group(df.unionAll(spark.createDataFrame([("new", 1)], "c string, y int")), groups, "c", "g").collect()
    assert Counter(r.g for r in marked) == Counter(want.get("Boş" if c is None else c.strip(), want["?"]) for c, _ in [*rows, ("new", 1)])


def test_groups_of_very_many_categories(spark, monkeypatch):
    """More categories than fine bins: rates still rise with the groups, no category is lost, none becomes a literal."""
    n = 30_000
    df = spark.range(2 * n).select((F.col("id") % n).cast("string").alias("c"), (F.col("id") % n < F.when(F.col("id") < n, n / 2).otherwise(n / 4)).cast("int").alias("y"))
    groups = variables.target_groups(df, "c", "y", 1)
    assert groups.count() == n
    marked = variables.with_group(df, groups, "c", "g")
    rates = [r.r for r in marked.groupBy("g").agg(F.avg("y").alias("r")).orderBy(F.substring("g", 2, 9).cast("int")).collect()]
    assert rates == sorted(rates) and rates[0] == 0 and rates[-1] == 1 and len(rates) == 3
    monkeypatch.setattr(variables, "SLOTS", 50)
    again = variables.target_groups(df, "c", "y", 1)
    assert again.select("grp").distinct().count() >= 2 and again.count() == n
    with pytest.raises(ValueError):
        remedies.learn_target_groups(df, "c", "y")


def test_attach_keeps_every_row(spark, monkeypatch):
    import tabloom.functions.joins as joins

    rows = spark.createDataFrame([(None, 1)] * 50 + [("hot", 2)] * 60 + [(f"k{i}", i) for i in range(40)] + [("unknown", 9)], "k string, i int")
    found = rows.where("k IS NOT NULL AND k <> 'unknown'").groupBy("k").agg(F.count("*").alias("n"), F.max("i").alias("m"))
    want = Counter((r.k, r.i, r.m) for r in rows.join(found, "k", "left").collect())
    for limit in (20_000, 5):
        monkeypatch.setattr(joins, "BROADCAST", limit)
        assert Counter((r.k, r.i, r.m) for r in attach(rows, found, "k", "n", 100).collect()) == want


@pytest.mark.parametrize(("name", "text", "kind"), [("MUSTERI_YAS", "", "yaş"), ("PAGE", "", None), ("AGE", "", "yaş"), ("DINAMIK", "", None), ("DIN", "", "din"), ("X", "kişinin medeni hali", "medeni hâl")])
def test_sensitive(name, text, kind):
    assert variables.sensitive(name, text) == kind


def test_few_values_come_in_one_job(spark, monkeypatch):
    """50 values of very different counts took a job for nearly every cut before; the cuts are those of the plain rule."""
    counts = [(float(i), 1 + (i * 7919) % 991) for i in range(50)]
    values = spark.createDataFrame([("a", v, variables.TRAIN, n) for v, n in counts], "k string, v double, s string, n long")
    run = variables.running(values).cache()
    asked = []
    real = type(run).join
    monkeypatch.setattr(type(run), "join", lambda self, *rest, **named: (asked.append(1), real(self, *rest, **named))[1])
    assert variables.equal_cuts(run) == {"a": binning.equal_cuts(counts, variables.FINE)}
    assert len(asked) == 1
