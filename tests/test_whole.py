"""Queries that do the whole job: all months, all words, all seeds."""

from __future__ import annotations

import inspect

import pytest
from pyspark.sql import functions as F

import oracle
from tabloom.functions import language
from tabloom.operators import features, measures, remedies, select
from tabloom.plans import catalog
from tabloom.plans.base import OBS, ORDERS

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()
OBSERVED = sorted(n for n, q in SQL.items() if OBS in q)


@pytest.fixture(scope="module")
def con(small):
    return oracle.connect(small)


def test_observed():
    assert "WHERE" not in OBS and {"flagship_windows", "join_asof", "merge_plan"} <= set(OBSERVED) and len(OBSERVED) == 11


@pytest.mark.parametrize("name", OBSERVED)
def test_all_months(spark, small, con, name):
    df = QUERIES[name](spark, small)
    assert df.count() == con.execute("SELECT count(DISTINCT (o_custkey, year(o_orderdate), month(o_orderdate))) FROM orders").fetchone()[0]
    assert oracle.differences(df, con, SQL[name]) == []


def _word(i: int) -> str:
    return "q" + "".join(chr(97 + i // 26**k % 26) for k in range(3))


def test_score_of_all_words(spark):
    """2,400 words with support, the last 400 in every fifth text only; keys and texts repeat, and one text is null."""
    rows = [(i // 2, None if i == 7 else " ".join(_word(j) for j in (range(2000) if i % 5 else range(1990, 2400))), int(i % 5 == 0 or i % 7 == 0), i < 300) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, t string, y int, tr boolean")
    folds = {r.id: r.f for r in df.select("id", features.fold_of(["id"]).alias("f")).collect()}
    got = sorted(((r.id, r.t or "", r.tr, r["t__SKOR"]) for r in remedies.text_score(df, F.col("tr"), "t", "y", ["id"]).collect()), key=repr)
    woe = {}
    for f in [-1, *range(5)]:
        part = df.where("tr") if f < 0 else df.where(F.col("tr") & (features.fold_of(["id"]) != f))
        woe[f] = {r.word: r.woe for r in remedies.word_table(part, "t", "y").collect()}
    assert len(woe[-1]) == 2400
    want = []
    for i, text, _, tr in rows:
        own = woe[folds[i] if tr else -1]
        hits = [own[w] for w in (text or "").split() if w in own]
        want.append((i, text or "", tr, sum(hits) / len(hits) if hits else None))
    want.sort(key=repr)
    assert len(got) == len(want) == 400
    for a, b in zip(got, want, strict=True):
        assert a[:3] == b[:3] and a[3] == pytest.approx(b[3])


def test_models_with_defaults(spark, small, monkeypatch):
    """The registered model queries run at full settings; calls are recorded, no model is fitted here."""
    calls = {}

    def record(module, name, out):
        real = inspect.signature(getattr(module, name))

        def stub(*args, **kwargs):
            bound = real.bind(*args, **kwargs)
            bound.apply_defaults()
            calls[name] = bound.arguments
            return out

        monkeypatch.setattr(module, name, stub)

    record(select, "importance", {"a": 1.0})
    record(select, "compare", spark.range(1))
    record(remedies, "topics", spark.range(1))
    for name in ("model_importance", "model_comparison", "text_topics"):
        QUERIES[name](spark, small)
    assert (calls["importance"]["trees"], calls["importance"]["depth"]) == (150, 8)
    assert (calls["compare"]["seeds"], calls["compare"]["iterations"]) == ((1, 2, 3, 4, 5), 20)
    assert calls["topics"]["k"] == 8


def test_months_have_amounts(spark, small, con):
    sql = f"SELECT o_custkey, mon, round(sum(amt), 2) AS total, count(amt) AS filled, count(*) AS n_rows FROM {ORDERS} GROUP BY 1, 2"
    assert oracle.differences(QUERIES["months_grid"](spark, small), con, sql) == []


def test_no_task_sorts_all_values(spark):
    """Three million values are cumulated in ranges, with the sums of one window."""
    run = measures.cumulate(spark.range(3_000_000).withColumn("n", F.lit(2)), [], "id", ["n"])
    parts = run.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("n_before") != 2 * F.col("id")).alias("wrong")).collect()
    assert sum(r.rows for r in parts) == 3_000_000 and not any(r.wrong for r in parts)
    assert max(r.rows for r in parts) < 1_500_000


def test_ranks_of_expressions_use_no_window(spark):
    """A rank over the whole table comes from its distinct values; nulls have none, ranks may be nested, repeated and in a formula."""
    df = spark.createDataFrame([(i, None if i % 5 == 0 else float(i % 7)) for i in range(100)], "id int, x double")
    out = language.apply(df, [("a", "rank(x)"), ("b", "1 - rank(2 * x) / 2"), ("c", "rank(rank(-x))")])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Window [" not in plan and out.columns == ["id", "x", "a", "b", "c"]
    old = df.select("id", *[language.expression(t, df.columns).alias(n) for n, t in (("a", "rank(x)"), ("b", "1 - rank(2 * x) / 2"))])
    want = {r.id: (r.a, r.b) for r in old.collect()}
    got = {r.id: r for r in out.collect()}
    assert len(got) == 100 and all((r.a is None) == (i % 5 == 0) for i, r in got.items())
    for i, r in got.items():
        if r.a is not None:
            assert (r.a, r.b) == pytest.approx(want[i]) and r.c == pytest.approx(1 - r.a + 1 / 80)


def test_models_learn_from_cells(spark):
    """Draws of rows depend on their cells, so partitions change no importance and no AUC; every row has its weight."""
    rows = spark.range(4_000).select("id", (F.col("id") % 9).cast("double").alias("a"), F.when(F.col("id") % 4 > 0, (F.col("id") * 7 % 50).cast("double")).alias("b"), ((F.col("id") % 9 > 4) != (F.col("id") % 11 == 0)).cast("int").alias("y"))
    dealt = rows.repartition(7, F.xxhash64("id"))
    one, two = (select.importance(d, ["a", "b"], "y", trees=4, depth=3) for d in (rows, dealt))
    assert one == pytest.approx(two, abs=1e-12) and sum(one.values()) == pytest.approx(1) and one["a"] > 0.9
    one, two = (select.compare(d.where("id % 3 > 0"), d.where("id % 3 = 0"), ["b"], ["a"], "y", seeds=(1,), iterations=2).first() for d in (rows, dealt))
    assert tuple(one) == pytest.approx(tuple(two), abs=1e-12) and one.delta > 0.2
    cells = select.model_cells(rows, ["a", "b"], "y", select.learn_cuts(rows, ["a", "b"]), {"b": 24.0})
    assert cells.agg(F.sum("n")).first()[0] == 4_000 and {r.m1: r.n for r in cells.groupBy("m1").agg(F.sum("n").alias("n")).collect()} == {0.0: 3_000, 1.0: 1_000}


def test_text_scores_read_words_twice(spark, monkeypatch):
    """Words by fold are counted in one pass and met in another; the tables are those of each fold's other rows."""
    rows = [(i, f"kredi w{i % 3} " + ("borç" if i % 4 else "hasar"), int(i % 5 < 2 + i % 2)) for i in range(600)]
    df = spark.createDataFrame(rows, "id int, t string, y int")
    fold, train = features.fold_of(["id"]), F.col("id") < 500
    got = {(r.word, r["__f"]): r.woe for r in remedies._fold_words(df.where(train), "t", "y", fold).collect()}
    want = {(r.word, f): r.woe for f in range(-1, 5) for r in remedies.word_table(df.where(train & (fold != f)) if f >= 0 else df.where(train), "t", "y").collect()}
    assert got.keys() == want.keys() and len(got) == 18 and all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)
    calls, words = [], remedies.words
    monkeypatch.setattr(remedies, "words", lambda c: calls.append(1) or words(c))
    assert remedies.text_score(df, train, "t", "y", ["id"]).count() == 600
    assert len(calls) == 2
