"""Null rules, micro tables and properties that no single query shows."""

from __future__ import annotations

import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tabloom.functions import exprs, language, periods
from tabloom.operators import binning, checks, convert, dictionary, features, measures, merge, profile, remedies, select, split
from tabloom.operators.merge import Aggregate, Plan, Source
from tabloom.sources import store, tables


def test_point_in_time_micro_table(spark):
    """Observation month 6, three-month window: sums of nulls are 0, absent windows null, the own month never counts."""
    rows = [(1, 1, 5.0), (1, 2, None), (1, 5, 7.0), (2, 1, None), (2, 1, None), (3, 6, 2.0), (None, 3, 9.0)]
    trx = spark.createDataFrame(rows, "k int, m int, v double").withColumn("rid", F.monotonically_increasing_id())
    main = spark.createDataFrame([(1, 6), (2, 6), (3, 6), (None, 6)], "k int, m int")
    names = [(f"{f}_{w}", Aggregate(f, w, None if f == "count" else "v")) for f in merge.FUNCTIONS for w in ("son_3a", "tum")]
    got = {r.k: r.asDict() for r in merge.pit_aggregate(main, trx, ["k"], "m", "m", names, ["m", "rid"]).collect()}
    assert (got[1]["sum_son_3a"], got[1]["sum_tum"], got[1]["count_son_3a"], got[1]["last_tum"]) == (7, 12, 1, 7)
    assert abs(got[1]["std_tum"] - math.sqrt(2)) < 1e-12 and got[1]["nunique_tum"] == 2
    assert (got[2]["sum_son_3a"], got[2]["sum_tum"], got[2]["count_son_3a"], got[2]["std_tum"], got[2]["last_tum"], got[2]["nunique_tum"]) == (None, 0, None, None, None, 0)
    assert all(v is None for k, v in got[3].items() if k not in ("k", "m")) and all(v is None for k, v in got[None].items() if k not in ("k", "m"))


def test_asof_micro_table(spark):
    dim = spark.createDataFrame([(1, 3, "a"), (1, 5, "b"), (1, 5, "c"), (2, 9, "x"), (None, 1, "n")], "k int, m int, v string")
    main = spark.createDataFrame([(1, 5), (1, 4), (1, 2), (2, 8), (None, 5)], "k int, m int")
    got = {(r.k, r.m): r.v for r in merge.asof_join(main, dim.withColumnRenamed("m", "dm"), ["k"], "m", "dm", ["v"], ["v"]).collect()}
    assert got == {(1, 5): "c", (1, 4): "a", (1, 2): None, (2, 8): None, (None, 5): None}


def test_plan_validation():
    plan = Plan("main", [Source("t", "islem", ["k"], None, aggregates=[Aggregate("sum", "son_3a", "v"), Aggregate("last", "tum", "v"), Aggregate("sum", "tum", "v")]), Source("gone", "boyut", ["k"], columns=["x"])], "p")
    ok, notes = merge.validate(plan, {"main": ["k", "p"], "t": ["k", "v"]})
    assert [a.window for a in ok.sources[0].aggregates] == ["tum"] and len(notes) == 3
    used: set[str] = set()
    names = [merge.output_name("T_ISLEM", Aggregate("sum", "tum", "A" * 16 + s), used) for s in "xy"]
    assert names[0] != names[1] and len(used) == 2


def test_merge_failures_are_isolated(spark):
    read = {"main": spark.createDataFrame([(1, "202401")], "k int, p string"), "old": spark.createDataFrame([(1, "190101", 3)], "k int, p string, v int"), "dim": spark.createDataFrame([(1, "z")], "k int, z string")}
    plan = Plan("main", [Source("old", "islem", ["k"], "p", aggregates=[Aggregate("sum", "tum", "v")]), Source("dim", "boyut", ["k"], columns=["z"])], "p")
    out, lineage, outcome = merge.execute(plan, read.__getitem__)
    assert dict(outcome)["dim"] == "ok" and "scale" in dict(outcome)["old"]
    assert out.columns == ["k", "p", "z"] and len(lineage) == 3


def test_union_needs_equal_columns(spark):
    a = spark.range(1)
    with pytest.raises(merge.PlanError):
        merge.union_all([a, a.withColumn("x", F.lit(1))])


def test_conversion_aborts_or_skips(spark):
    df = spark.createDataFrame([("1,5",), ("x",), (None,), ("",)], "v string")
    with pytest.raises(convert.ConversionError):
        convert.apply(df, [("v", "sayisal_virgul")])
    out, skipped = convert.apply(df, [("v", "sayisal_virgul")], strict=False)
    assert skipped == ["v"] and out.schema == df.schema
    floats = spark.createDataFrame([(202501.0,), (None,)], "p double")
    assert [r.p for r in convert.apply(floats, [("p", "donem_ym6")])[0].collect()] == [202501.0, None]
    with pytest.raises(convert.ConversionError):
        convert.apply(spark.createDataFrame([(202501.5,)], "p double"), [("p", "donem_ym6")])


def test_division_and_clip(spark):
    row = spark.createDataFrame([(1.0, 0.0, None, "x", float("nan"))], "a double, z double, n double, s string, q double").select(
        exprs.div(F.col("a"), F.col("z")).alias("d"), exprs.num(F.col("s")).alias("s"), exprs.num(F.col("q")).alias("q"), exprs.clip(F.col("n"), F.lit(0.0), F.lit(1.0)).alias("c"),
    ).first()
    assert tuple(row) == (None, None, None, None)


def test_turkish_folding(spark):
    df = spark.createDataFrame([("İSTANBUL  ığdır ",), ("ISPARTA",)], "v string")
    assert [r[0] for r in df.select(exprs.spelling_key(F.col("v"))).collect()] == ["istanbul igdir", "isparta"]


@pytest.mark.parametrize("bad", ["1 + 1", "a.b", "__import__('x')", "a if a else a", "log1p(1)", "nope(a)", "x + a", "a[0]", "lambda: a", "'s' + a", "a ** 2", "True + a", "clip(a, 1)", "a +", "a" * 200, "+".join(["a"] * 50)])
def test_language_refuses(bad):
    with pytest.raises(language.ExpressionError):
        language.parse(bad, ["a", "b"])


def test_language_script():
    text = language.script([("y", "a / b"), ("z", "y * 2")], ["a", "b"])
    assert "expression('a / b', df.columns)" in text
    compile(text, "s", "exec")
    with pytest.raises(language.ExpressionError):
        language.script([("class", "a")], ["a"])


def test_period_formats(spark):
    for values, form in ((["202501", "202513"], None), (["202501", "20250101"], None), (["20250131"], "YYYYMMDD"), (["2025M1", "2025/02"], "year-month"), (["nan", "-"], None), (["5"], None)):
        df = spark.createDataFrame([(v,) for v in values], "p string")
        assert periods.decide(df, "p") == form, values
    assert periods.decide(spark.createDataFrame([(202501.0,), (None,)], "p double"), "p") == "YYYYMM"
    assert periods.decide(spark.sql("select timestamp'2024-02-03' p"), "p") == "date"


def test_quantiles_by_ranges(spark, monkeypatch):
    """The distributed plan gives what the small one gives."""
    rng = random.Random(1)
    rows = [(g, float(rng.randrange(50)), rng.randrange(1, 5)) for g in "ab" for _ in range(40)]
    tt = spark.createDataFrame(rows, "g string, v double, n long").groupBy("g", "v").agg(F.sum("n").alias("n"))
    want = sorted(map(tuple, measures.quantiles(tt, ["g"], "v", "n", (0.1, 0.5, 0.9)).collect()))
    monkeypatch.setattr(measures, "SMALL", 5)
    assert sorted(map(tuple, measures.quantiles(tt, ["g"], "v", "n", (0.1, 0.5, 0.9)).collect())) == want


def test_splits_are_proportional_and_stable(spark):
    df = spark.range(2000).withColumn("y", (F.col("id") % 4 == 0).cast("int")).withColumn("seg", F.when(F.col("id") % 3 == 0, "a"))
    out = split.stratified(df, ["id"], ["y", "seg"], [("test", 0.25), ("val", 0.1)])
    again = split.stratified(df.repartition(7), ["id"], ["y", "seg"], [("test", 0.25), ("val", 0.1)])
    assert {tuple(r) for r in out.collect()} == {tuple(r) for r in again.collect()}
    for r in out.groupBy("y", "seg").agg(F.count_if(F.col(split.SPLIT) == "test").alias("t"), F.count(F.lit(1)).alias("n")).collect():
        assert abs(r.t - 0.25 * r.n) <= 0.5


def test_tiny_strata_keep_a_train_row(spark):
    df = spark.createDataFrame([(1, 0), (2, 1), (3, 1), (4, 2), (5, 2), (6, 2)], "id int, s int")
    got = {r.id: r[split.SPLIT] for r in split.stratified(df, ["id"], ["s"], [("test", 0.01), ("val", 0.01)]).collect()}
    assert got[1] == "train" and {got[2], got[3]} == {"train"} and sorted(got[i] for i in (4, 5, 6)) == ["test", "train", "val"]


def test_groups_stay_together(spark):
    df = spark.range(300).withColumn("g", F.when(F.col("id") % 10 != 0, F.col("id") % 37)).withColumn("y", F.col("id") % 2)
    out = split.folds(df, ["id"], ["y"], 4, group="g", repeats=2)
    assert out.where("g IS NOT NULL").groupBy("g").agg(F.count_distinct("fold_0").alias("n"), F.count_distinct("fold_1").alias("m")).where("n <> 1 OR m <> 1").count() == 0
    assert out.where("fold_0 IS NULL").count() == 0


def test_temporal_plan_keeps_a_period():
    counts = [("1", 10), ("2", 10), ("3", 10)]
    assert split.temporal_plan(counts, ["3"], 5, 0.5) == {"3": "test", "2": "disarida", "1": "train"}
    assert split.temporal_plan(counts, ["3"], 0, 0.9) == {"3": "test", "2": "val", "1": "train"}


def test_encoding_is_out_of_fold(spark):
    """A category with one train row tells that row nothing about its own target."""
    rows = [(i, f"only{i}" if i < 5 else "c", i % 2, True) for i in range(60)] + [(99, "only0", None, False), (98, "new", 1, False)]
    df = spark.createDataFrame(rows, "id int, c string, y int, tr boolean")
    got = {r.id: r for r in features.encode(df, F.col("tr"), "c", "y", ["id"]).collect()}
    assert all(got[i]["c__WOE"] == 0 for i in range(5))
    assert got[99]["c__WOE"] != 0 and got[98]["c__WOE"] == 0 and got[98]["c__FRK"] == 0


def test_family_discovery():
    found = features.families(["A_L30D", "A_L90D", "B_SON3A", "C", "B_SON12A_X"])
    assert list(found) == ["A"] and [d for _, d in found["A"]] == [30, 90]
    assert features.window_days("SON3A") == 90 and features.window_days("XY") is None
    assert features.concentration_groups(["TXN_A_AMT", "TXN_B_AMT", "TXN_TOPLAM_AMT"]) == {"TXN_TOPLAM_AMT": ["TXN_A_AMT", "TXN_B_AMT"]}
    assert features.estimate(4, ("oran", "oran_tum", "egim")) == 3 + 6 + 1
    assert features.prune(["a__DIV__b", "a__NDIV__b"]) == ["a__DIV__b"]


counts = st.lists(st.tuples(st.integers(1, 60), st.floats(0, 1)), min_size=2, max_size=14)


@settings(max_examples=100, deadline=None)
@given(counts)
def test_binning_properties(cells):
    fine = [binning.Bin(n, round(n * p)) for n, p in cells]
    bins, form = binning.best_bins(fine)
    assert sum(b.n for b in bins) == sum(b.n for b in fine) and sum(b.bad for b in bins) == sum(b.bad for b in fine)
    assert len(bins) <= binning.MOST and form in ("düz", "artan", "azalan", "U", "ters U", "düzensiz")
    assert len(bins) == 1 or min(b.n for b in bins) >= binning.MIN_SHARE * sum(b.n for b in fine)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 9), min_size=1, max_size=60), st.integers(2, 8))
def test_equal_cuts(sizes, k):
    cuts = binning.equal_cuts([(float(i), n) for i, n in enumerate(sizes)], k)
    assert cuts == sorted(set(cuts)) and len(cuts) <= k - 1


def test_fine_cuts_distributed(spark):
    df = spark.range(3000).select((F.pow(F.col("id") % 977, F.lit(2))).alias("x"))
    assert binning.fine_cuts(df, "x", 20, grid=100) == binning.fine_cuts(df, "x", 20, grid=10_000)


def test_labels():
    assert binning.labels([1000.0, 2500.5]) == ["≤ 1.000", "1.000 - 2.500,5", "> 2.500,5"]


def test_prune_and_gate():
    assert select.prune_correlated({("a", "b"): 0.99, ("b", "c"): -0.97, ("a", "c"): 0.1}, {"a": 3, "b": 2, "c": 1}) == {"b": "a"}
    assert select.gate({})[0] == "kosullu" and select.gate({"psi": 0.9})[0] == "kaldi"
    assert select.unimportant({"a": 1.0, "b": 0.0}) == ["b"]


def test_survivor_of_copies():
    assert checks.keep_of_copies([("a", "b"), ("b", "c")], {"b": 0.7}, {"a": 2}, ["a", "b", "c", "d"]) == {"a": "b", "b": "b", "c": "b"}
    assert checks.never_negative("Gün Sayısı") and checks.never_negative("ADET") and not checks.never_negative("Tutar")


def test_names():
    assert dictionary.edit_distance("adet", "daet") == 1 and dictionary.edit_distance("ab", "b") == 1
    assert dictionary.future_columns(["TXN_NEXT3M", "TXN_L3M"]) == ["TXN_NEXT3M"]
    assert dictionary.transfer("T_L90D", "T_L30D", "son 30 gün") == "son 90 gün" and dictionary.transfer("A", "B", "x") is None
    assert dictionary.inconsistent("T_L90D", "son 30 gün") == ["L90D"]
    assert dictionary.standard_name("l30d_txn__amt") == "TXN_AMT_L30D"
    assert dictionary.adjacent(["A_B_1", "A_B_2", "A_B_3"]) == {("A", "B"): 3}
    assert dictionary.similar_tokens(["TUTAR_X", "TUTRA_Y"]) == [["TUTAR", "TUTRA"]]
    assert dictionary.period_patterns(["A_L3M", "B_L6M"]) == {"L#M": (2, ["A_L3M", "B_L6M"])}


def test_abbreviations(spark):
    rows = [(f"TXN_AMT_{i}", "işlem tutarı") for i in range(4)] + [(f"CUST_AGE_{i}", "müşteri yaşı") for i in range(4)]
    got = {(r.token, r.word): r.lift for r in dictionary.abbreviations(spark.createDataFrame(rows, "name string, description string")).collect()}
    assert got["TXN", "işlem"] == 2.0 and ("TXN", "müşteri") not in got


def test_dictionary_upkeep(spark):
    d = spark.createDataFrame([("a", "x"), ("gone", "y"), ("b", "")], "DEGISKEN string, ACIKLAMA string")
    cols = spark.createDataFrame([("a",), ("b",), ("new",)], "column string")
    made = spark.createDataFrame([("new", "made"), ("b", "filled")], "name string, description string")
    assert {tuple(r) for r in dictionary.refresh(d, cols, made).collect()} == {("a", "x"), ("b", "filled"), ("new", "made")}
    lineage = spark.createDataFrame([("a_sum", "a", "sum", "son_3a"), ("q", "zz", None, None)], "column string, source_column string, function string, window string")
    assert {tuple(r) for r in dictionary.inherit(lineage, d).collect()} == {("a_sum", "x (sum, son_3a)"), ("q", None)}


def test_remedies(spark):
    df = spark.createDataFrame([(i, f"AB{i % 4}{i % 10}", (i % 4 == 0) * 1, i * 1.0) for i in range(400)], "id int, c string, y int, x double")
    assert remedies.prefix_length(df, "c") == 3
    groups = remedies.learn_target_groups(df.withColumn("c", F.substring("c", 1, 3)), "c", "y")
    assert groups["AB0"] != groups["AB1"] and groups["AB1"] == groups["AB2"]
    assert remedies.groups_hold(df.withColumn("c", F.substring("c", 1, 3)), "c", "y", F.floor(F.col("id") / 4) % 2)
    row = spark.createDataFrame([(" ?", "İstanbul ", -1.0, 2.5)], "t string, s string, n double, h double").select(
        remedies.empty_text_to_null("t").alias("t"), remedies.canonical_spelling("s", {"istanbul": "İstanbul"}).alias("s"), remedies.negative_to_null("n").alias("n"), remedies.code_to_null("n", -1).alias("c"), remedies.rounded("h", 0).alias("h"),
    ).first()
    assert tuple(row) == (None, "İstanbul", None, None, 2)
    assert [s[0] for s in remedies.in_order([("clip", "a", F.lit(1)), ("spelling", "b", F.lit(1))])] == ["spelling", "clip"]


def test_negatives_go_before_rounding(spark):
    """As in the original: a value just below 0 is missing, not a rounded 0."""
    steps = remedies.in_order([("round", "x", remedies.rounded("x", 0)), ("clip", "x", remedies.upper_clip("x", 2.5)), ("negative", "x", remedies.negative_to_null("x"))])
    df = spark.createDataFrame([(-0.3,), (0.3,), (-2.0,), (9.0,)], "x double")
    for _, column, value in steps:
        df = df.withColumn(column, value)
    assert [r.x for r in df.collect()] == [None, 0, None, 2]


def test_topics_and_text_score(spark):
    rows = [(i, ("kredi kart borç" if i % 2 else "sigorta poliçe hasar") + f" w{i % 3}", i % 2) for i in range(120)]
    df = spark.createDataFrame(rows, "id int, t string, y int")
    assert remedies.topics(df, "t", "id", k=2).select("topic").distinct().count() == 2
    got = remedies.text_score(df, F.col("id") < 100, "t", "y", ["id"]).collect()
    assert all((r["t__SKOR"] < 0) == (r.y == 1) for r in got if r["t__SKOR"] is not None)


def test_models(spark):
    rows = [(i, float(i % 50), float((i * 7) % 13), None if i % 9 == 0 else float(i % 5), int(i % 50 > 25)) for i in range(600)]
    df = spark.createDataFrame(rows, "id int, a double, b double, c double, y int")
    imp = select.importance(df, ["a", "b", "c"], "y", trees=10, depth=3)
    assert max(imp, key=imp.get) == "a"
    got = select.compare(df.where("id % 3 <> 0"), df.where("id % 3 = 0"), ["b"], ["a"], "y", seeds=(1,), iterations=3).first()
    assert got.delta > 0.2 and select.interval([0.1, 0.3])[0] == pytest.approx(0.2)
    assert features.linear_gain(df, "b", "a", "y", ["id"]) > 0.2
    assert select.best_model(df, ["a", "b"], "y", folds=2)[0][1] > 0.9
    assert features.worth(0.03, 0.5) and not features.worth(0.03, 0.99)


def test_store_and_tables(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, "x")], "a int, b string").withColumn("v", F.lit(None))
    path = str(tmp_path / "t.parquet")
    tables.write_parquet(df, path)
    assert tables.read_table(spark, str(tmp_path), "t").schema["v"].dataType.simpleString() == "string"
    tables.write_records(df.drop("v"), str(tmp_path / "j.json"))
    assert tables.read_table(spark, str(tmp_path), "j", 1).count() == 1
    with pytest.raises(FileNotFoundError):
        tables.read_table(spark, str(tmp_path), "none")
    copy = tables.base_copy(df.drop("v"), str(tmp_path / "base"))
    assert tables.base_copy(df.drop("v").limit(0), str(tmp_path / "base")).count() == copy.count() == 2
    kept = store.materialise(df.drop("v"), "test")
    assert kept.count() == 2 and "tabloom-test" in kept.inputFiles()[0]
    assert tables.current(spark, ["no_such_copy"], "base") == ("base", False)
    assert tables.stage(df, [lambda d: d.where("a = 1"), lambda d: d.drop("v")]).count() == 1


def test_empty_table_profile(spark):
    df = spark.createDataFrame([], "a int, b string, c double")
    got = {r["column"]: r for r in profile.profile(df).collect()}
    assert got["a"].filled == 0 and got["b"].distinct == 0 and got["c"].distinct_with_null == 0
    assert merge.duplicates(df, "a").first().full_rows in (0, None)


def test_streaming_profile(spark, tmp_path):
    from tabloom.streaming.monitor import profile_stream

    df = spark.range(10).withColumn("x", F.col("id") % 3)
    df.write.parquet(str(tmp_path / "in"))
    seen = []
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    profile_stream(stream, ["x"], lambda p, n: seen.extend(p.collect()), str(tmp_path / "cp")).awaitTermination(120)
    assert seen[0].distinct == 3 and seen[0].filled == 10


def test_plans_decode_a_period_once(spark, tmp_path):
    """Filters on the month index run on what was written; before, they held the decoding of the text many times over."""
    obs = spark.createDataFrame([(1, "202403"), (1, "202401"), (2, None)], "k int, ym string")
    trx = spark.createDataFrame([(1, "20240115", 2.0), (1, "2024-02-03".replace("-", ""), 3.0), (2, None, 5.0)], "k int, ym string, amt double")
    plan = merge.Plan("obs", [merge.Source("trx", "islem", ["k"], "ym", aggregates=[merge.Aggregate("sum", "tum", "amt")])], "ym")
    out, _, outcome = merge.execute(plan, {"obs": obs, "trx": trx}.__getitem__)
    assert outcome == [("trx", "ok")] and "__obs" not in out.columns
    assert sorted((r[0], str(r[1]), r[2]) for r in out.collect()) == [(1, "202401", None), (1, "202403", 5.0), (2, "None", None)]
    assert "rlike" not in out._jdf.queryExecution().optimizedPlan().toString().lower()
