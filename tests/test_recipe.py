"""Recipes: what is rebuilt equals what was fitted, and what doesn't fit is refused."""

from __future__ import annotations

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tabloom.operators import convert, features, recipe, split
from tabloom.operators.columns import Roles
from tabloom.operators.recipe import RecipeError, Step
from tabloom.sources import store, tables

ROLES = Roles(target="y", ident="id")


@pytest.fixture(scope="module")
def base(spark):
    df = spark.range(600).select(
        "id", (F.col("id") % 60).alias("client"), (F.col("id") % 7 < 2).cast("int").alias("y"), F.format_number(F.col("id") * 13.5, 2).alias("price"),
        F.when(F.col("id") % 5 != 0, F.col("id") % 17).cast("double").alias("x"), F.when(F.col("id") % 11 != 0, F.concat(F.lit("k"), F.col("id") % 9)).alias("cat"),
        F.lit(1).alias("same"), F.date_format(F.date_add(F.lit("2024-01-15"), (F.col("id") % 6 * 30).cast("int")), "yyyy-MM").alias("month"), F.lit("w").alias("__k"),
    )
    path = f"{store.scratch(spark, 'recipe-base')}"
    return tables.base_copy(df.repartition(3), path), path


def steps(method: dict) -> list[Step]:
    return [
        Step("convert", {"changes": {"price": "sayisal_nokta"}}, "01"),
        Step("drop", {"columns": ["same", "y"]}, "01"),
        Step("split", method, "01"),
        Step("fill", {"columns": ["x"]}, "02.1"),
        Step("clip", {"columns": ["price"], "high": 0.9}, "02.1"),
        Step("rename", {"names": {"x": "x1"}}, "02.1"),
        Step("deciles", {"columns": ["price"]}, "02.2"),
        Step("bins", {"columns": ["x1"], "bins": 4}, "02.2"),
        Step("encode", {"column": "cat", "target": "y", "keys": ["id"]}, "02.2"),
        Step("expressions", {"columns": {"r": "price / x1", "r2": "log1p(r) + cat__TE"}}, "02.2"),
    ]


ROWS = {"method": "rows", "keys": ["id"], "strata": ["y"], "ratios": {"test": 0.2, "val": 0.1}}
IDS = {"method": "ids", "ident": "client", "strata": ["y"], "seed": 7}
PERIODS = {"method": "periods", "period": "month", "test": ["2024-06"], "val": 0.2}


@pytest.fixture(scope="module")
def fitted_rows(base):
    made, fitted = recipe.fit(base[0], steps(ROWS), ROLES)
    return made, store.materialise(fitted, "fitted")


@pytest.mark.parametrize("method", [ROWS, IDS, PERIODS], ids=lambda m: m["method"])
def test_rebuilt_equals_fitted(spark, base, method):
    df, path = base
    made, fitted = recipe.fit(df, steps(method), ROLES)
    root = store.scratch(spark, "recipes")
    assert recipe.save(spark, made, root, "model") == 1
    got = recipe.load(spark, root, "model")
    again = recipe.rebuild(got, spark.read.parquet(path).repartition(7))
    assert again.columns == fitted.columns and again.count() == 600
    assert again.exceptAll(fitted).isEmpty() and fitted.exceptAll(again).isEmpty()
    assert "same" not in again.columns and "y" in again.columns
    assert [dict(s.learnt) for s in got.steps] == [dict(s.learnt) for s in made.steps]


def test_same_as_the_operators(spark, base, fitted_rows):
    (df, _), (_, fitted) = base, fitted_rows
    plain = split.stratified(convert.apply(df, [("price", "sayisal_nokta")])[0], ["id"], ["y"], [("test", 0.2), ("val", 0.1)])
    train = F.col(split.SPLIT) == split.TRAIN
    median = features.learn_grid(plain.where(train), ["x"], (0.5,))["x"][0]
    want = features.encode(plain, train, "cat", "y", ["id"]).select("id", split.SPLIT, F.coalesce("x", F.lit(median)).alias("x1"), "cat__WOE", "cat__TE", "cat__FRK")
    got = fitted.select(*want.columns)
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_ids_stay_together(spark, base):
    df, _ = base
    _, fitted = recipe.fit(df, [Step("split", IDS)], ROLES)
    assert fitted.groupBy("client").agg(F.count_distinct(split.SPLIT).alias("n")).where("n <> 1").isEmpty()
    assert {r[0] for r in fitted.select(split.SPLIT).distinct().collect()} == {"train", "val", "test"}


def test_added_rows_move_no_row(spark, base):
    """Labels and encodings of known rows stay when the base grows."""
    df, _ = base
    made, fitted = recipe.fit(df, steps(ROWS), ROLES)
    more = df.unionByName(df.withColumn("id", F.col("id") + 1000))
    again = recipe.rebuild(made, more)
    assert again.count() == 1200
    assert again.where("id < 600").exceptAll(fitted).isEmpty() and again.where("__k <> 'w'").isEmpty()
    assert again.where("id >= 1000").select(split.SPLIT).distinct().count() == 3


def test_stages_and_versions(spark, base, fitted_rows):
    (df, path), (made, fitted) = base, fitted_rows
    root = store.scratch(spark, "recipes")
    first = recipe.write_stage(spark, made, path, root, "01")
    assert first.columns[-1] == split.SPLIT and "x" in first.columns and "same" not in first.columns
    assert recipe.write_stage(spark, made, path, root, "01").inputFiles() == first.inputFiles()
    assert recipe.write_stage(spark, made, path, root).exceptAll(fitted).isEmpty()
    assert recipe.signature(made, path, "01") != recipe.signature(made, path, "02.1") != recipe.signature(made, path + "2", "02.1")
    assert [recipe.save(spark, r, root, "m") for r in (made, made.until("01"))] == [1, 2]
    assert recipe.versions(spark, root, "m") == [1, 2] and recipe.versions(spark, root, "other") == []
    assert len(recipe.load(spark, root, "m").steps) == 3 and len(recipe.load(spark, root, "m", 1).steps) == 10
    with pytest.raises(RecipeError, match="no version"):
        recipe.load(spark, root, "m", 3)
    with pytest.raises(RecipeError, match="no stage"):
        made.until("09")


def test_changed_learnt_tables_are_refused(spark, base, fitted_rows):
    (df, _), (made, _) = base, fitted_rows
    root = store.scratch(spark, "recipes")
    recipe.save(spark, made, root, "m")
    made.steps[8].table.withColumn("n", F.col("n") + 1).write.mode("overwrite").parquet(f"{root}/m/learnt/v1/8")
    with pytest.raises(RecipeError, match="has changed"):
        recipe.load(spark, root, "m")


def test_what_does_not_fit(spark, base, fitted_rows):
    (df, _), (made, _) = base, fitted_rows
    with pytest.raises(RecipeError, match="column x is missing"):
        recipe.rebuild(made, df.drop("x"))
    with pytest.raises(RecipeError, match="column x is string"):
        recipe.rebuild(made, df.withColumn("x", F.col("x").cast("string")))
    with pytest.raises(RecipeError, match="there already"):
        recipe.rebuild(made, df.withColumn("PRICE__dlm", F.lit(1)))
    assert "more" in recipe.rebuild(made, df.withColumn("more", F.lit(1))).columns
    with pytest.raises(RecipeError, match="needs a split"):
        recipe.fit(df, [Step("fill", {"columns": ["x"]})])
    with pytest.raises(RecipeError, match="no column z"):
        recipe.fit(df, [Step("drop", {"columns": ["z"]})])
    with pytest.raises(RecipeError, match="no such kind"):
        recipe.fit(df, [Step("exec", {"code": "1"})])
    with pytest.raises(convert.ConversionError):
        recipe.fit(df.withColumn("price", F.lit("1,2,3")), [Step("convert", {"changes": {"price": "sayisal_nokta"}})])
    late = df.withColumn("price", F.when(F.col("id") == 77, "1,2,3").otherwise(F.col("price")))
    with pytest.raises(PySparkException, match="can't convert a value of price"):
        recipe.rebuild(made, late).collect()


def test_empty_and_null_bases(spark, base, fitted_rows):
    (df, _), (made, _) = base, fitted_rows
    assert recipe.rebuild(made, df.where("id < 0")).count() == 0
    empty, table = recipe.fit(df.where("id < 0"), steps(ROWS), ROLES)
    assert table.count() == 0 and recipe.rebuild(empty, df).where(F.col(split.SPLIT) != split.TRAIN).isEmpty()
    nulls = df.withColumns({c: F.lit(None).cast(t) for c, t in df.dtypes if c != "id"})
    assert recipe.rebuild(made, nulls).count() == 600
    twice = df.unionAll(df)
    _, table = recipe.fit(twice, [Step("split", ROWS)], ROLES)
    assert table.groupBy("id").agg(F.count_distinct(split.SPLIT).alias("n")).where("n <> 1").isEmpty()


def test_encodings_are_worked_out_by_category_and_fold(spark):
    """Rows look values up; no logarithm is left to work out for every row. The values follow the definition."""
    base = spark.range(600).select("id", (F.col("id") % 7 < 2).cast("int").alias("y"), F.when(F.col("id") % 11 != 0, F.concat(F.lit("k"), F.col("id") % 9)).alias("cat"))
    out = features.encode(base, F.col("id") < 500, "cat", "y", ["id"])
    plan = out._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "ln(" not in plan and "log(" not in plan
    rows = base.select("id", F.coalesce("cat", F.lit("__BOS__")).alias("c"), "y", features.fold_of(["id"]).alias("f")).collect()
    got = {r.id: r for r in out.collect()}
    for r in rows[::37]:
        own = [x for x in rows if x.id < 500 and (r.id >= 500 or x.f != r.f)]
        mine = [x for x in own if x.c == r.c]
        prior = sum(x.y for x in own) / len(own)
        assert got[r.id].cat__TE == pytest.approx((sum(x.y for x in mine) + 20 * prior) / (len(mine) + 20))


@pytest.mark.parametrize("strata", [[], ["s"], ["s", "t"]])
def test_ranges_rank_few_rows(spark, strata, monkeypatch):
    """Learnt ranges equal those of the rows that ``stratified`` labels, with null, small and rowless sets and repeated keys, but only a few rows are ranked."""
    df = spark.range(3_000).select((F.col("id") % 2_900).alias("id"), F.when(F.col("id") % 7 != 0, F.pmod(F.floor(F.sqrt("id")), F.lit(20))).alias("s"), (F.col("id") > 2_995).alias("t"), F.lit(5).alias("__k")).repartition(3)
    ratios = [("test", 0.2), ("val", 0.0), ("oot", 0.15)]
    labelled = split.stratified(df, ["id"], strata, ratios).withColumn("stratum", split.stratum(strata))
    lows = labelled.groupBy("stratum", split.SPLIT).agg(F.min(split.order_key(42, ["id"])).alias("low"), F.count(F.lit(1)).alias("n")).collect()
    want = {}
    for r in lows:
        n, ranges = want.get(r.stratum, (0, []))
        want[r.stratum] = n + r.n, sorted([*ranges, (r.low, r[split.SPLIT])])

    def refuse(*args):
        raise AssertionError("all rows would be ranked")

    monkeypatch.setattr(split, "_ranks", refuse)
    got = {r["__k"]: (r["__w"], [tuple(x) for x in r.ranges]) for r in split.learn_ranges(df, ["id"], strata, ratios).collect()}
    assert got == want
