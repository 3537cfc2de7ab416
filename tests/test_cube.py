"""Advice from the count cube, case by case."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tabloom.operators import cube


def advice(df, columns, **more):
    return {(r.column, r.finding): (r.advice, r.reason, r.figure, r.against) for r in cube.keep_or_drop(df, columns, "p", **more).collect()}


@pytest.fixture(scope="module")
def rows(spark):
    """Ten periods of 200 rows, in no order; a null period."""
    df = spark.range(2_000).withColumn("m", (F.col("id") % 10).cast("int")).withColumn("p", F.format_string("2024%02d", F.col("m") + 1))
    return df.unionAll(spark.range(5).select("id", F.lit(None).cast("int").alias("m"), F.lit(None).cast("string").alias("p"))).repartition(3)


def test_periods(rows):
    x = F.col("id").cast("double") + 0.5
    df = rows.select(
        "p", F.when(F.col("m") > 1, x).alias("first"), F.when(F.col("m") > 4, x).alias("half"), F.when(F.col("m") < 9, x).alias("last"), F.when(F.col("m") == 5, F.lit(1.5)).otherwise(x).alias("once"),
        F.when((F.col("m") < 5) | (F.col("id") % 20 == 9), x).alias("gone"), F.when((F.col("m") < 5) | (F.col("id") % 40 > 10), x).alias("more"), x.alias("full"), F.lit(None).cast("double").alias("none"), F.lit(3).alias("same"),
    )
    got = advice(df, [c for c in df.columns if c != "p"])
    assert got["first", "donem"][:3] == ("tut", "ilk_donemler", 2) and got["half", "donem"][:3] == ("cikar", "tutarsiz", 5)
    assert got["last", "donem"][:2] == ("cikar", "son_donem") and got["once", "donem"][:2] == ("cikar", "tutarsiz")
    assert got["none", "donem"][:3] == ("cikar", "son_donem", 10) and ("full", "donem") not in got and ("same", "donem") not in got
    assert got["first", "sicrama"] == ("tut", "azaldi", 1.0, 0.0) and got["last", "sicrama"] == ("cikar", "asti", 0.0, 1.0) and got["gone", "sicrama"][:2] == ("cikar", "asti")
    assert got["more", "sicrama"][1] in ("artti", "azaldi", "asti") and ("full", "sicrama") not in got


def test_dominant(rows):
    rare = F.col("id") % 200 == 7
    for y, beside, want in ((rare.cast("int"), 7, ("cikar", "az_satir")), ((rare | (F.col("id") % 10 == 0)).cast("int"), 0, ("tut", "ayirir")), (F.lit(0), 0, ("cikar", "olay_yok")), ((F.col("id") % 2 == 1).cast("int"), 0, ("tut", "ayirir")), ((F.floor(F.col("id") / 200) % 2).cast("int"), 0, ("cikar", "ayirmaz")), (F.col("id") * 0.1, 0, ("tut", "hedef_yok"))):
        df = rows.unionAll(rows).unionAll(rows).unionAll(rows).select("p", "id", F.when(rare, F.lit(1)).otherwise(0).alias("x"), y.alias("y"))
        more = {"target": "y"} if not beside else {"target": "y", "train": F.col("id") < 1_000 * (beside == 7)}
        got = advice(df, ["x"], **more)["x", "baskin"]
        assert got[:2] == want, (want, got)


def test_numbers_and_texts(rows):
    i = F.col("id")
    df = rows.select(
        "p", F.when(i % 100 == 3, -2.0).otherwise(i.cast("double")).alias("rare_negative"), F.when(i % 4 == 0, -i - 1.0).otherwise(i * 1.0).alias("many_negative"), F.when(i == 77, 1e9).otherwise(i % 50 + 0.25).alias("far"), F.when(i == 77, 999999.0).otherwise(i % 50 + 0.25).alias("code"),
        (i * 1.0).alias("whole"), (i * 1.0).alias("MUSTERI_NO"), (i / 3).alias("third"), (i % 100 + 0.5).alias("halves"), i.alias("long"),
        F.when(i % 10 == 0, " Bilinmiyor ").otherwise(F.concat(F.lit("v"), i % 7)).alias("many_spelled"), F.when(i % 100 == 0, "-").otherwise("x").alias("few_spelled"), F.when(i % 3 == 0, "ISPARTA").when(i % 3 == 1, "ısparta ").otherwise("isparta").alias("city"),
    )
    got = advice(df, [c for c in df.columns if c != "p"], described={"rare_negative": "gün sayısı", "many_negative": "adet", "far": "tutar"})
    assert got["rare_negative", "negatif"][:2] == ("negatif_bos", "az") and got["many_negative", "negatif"][:2] == ("birak", "sistematik") and ("far", "negatif") not in got
    assert got["far", "uc"] == ("kirp", "kat", 1e9, 49.25) and ("code", "uc") not in got
    assert got["whole", "ondalik"][0] == "tam_sayi" and got["MUSTERI_NO", "ondalik"][:2] == ("birak", "kod_adi") and got["third", "ondalik"][0] == "yuvarla" and ("halves", "ondalik") not in got and ("long", "ondalik") not in got
    assert got["many_spelled", "metin_bos"][:2] == ("metin_bos_bayrak", "cok") and got["few_spelled", "metin_bos"][:2] == ("metin_bos", "az")
    assert got["city", "yazim"][:3] == ("tek_yazim", "yazimlar", 1)


def test_drift(rows):
    x = F.col("id") % 100 + 5.0
    df = rows.select("p", F.when(F.col("m") > 4, x * 100).otherwise(x).alias("unit"), F.when(F.col("m") > 4, x * 47).otherwise(x).alias("grown"), F.when(F.col("m") > 4, x * 5).otherwise(x).alias("some"), F.when(F.col("m") > 4, x / 1000).otherwise(x).alias("less"))
    got = advice(df, ["unit", "grown", "some", "less"])
    assert got["unit", "kayma"][:2] == ("cikar", "birim") and got["grown", "kayma"][:2] == ("tut", "degisim") and ("some", "kayma") not in got and got["less", "kayma"][:2] == ("cikar", "birim")


def test_empty(rows):
    assert advice(rows.withColumn("x", F.col("id") * 1.5).limit(0), ["x"]) == {}


def test_cube_groups_numbers_as_numbers(spark):
    """The rows of a cube are those of values as text, but no number becomes text before rows are grouped."""
    df = spark.createDataFrame([("a", 1.5, 2, "x", 1), ("a", 1.5, None, None, 0), ("b", float("nan"), 2, "", 1), ("b", 0.0, 7, "1.5", None), (None, -0.0, 7, "x", 1)], "p string, f double, i int, t string, y int")
    got = cube.count_cube(df, ["f", "i", "t"], "p", "y")
    want = {("f", "a", "1.5", 2, 2, 1), ("f", "b", None, 1, 1, 1), ("f", "b", "0.0", 1, 0, 0), ("f", None, "0.0", 1, 1, 1), ("i", "a", "2.0", 1, 1, 1), ("i", "a", None, 1, 1, 0), ("i", "b", "2.0", 1, 1, 1), ("i", "b", "7.0", 1, 0, 0), ("i", None, "7.0", 1, 1, 1), ("t", "a", "x", 1, 1, 1), ("t", "a", None, 1, 1, 0), ("t", "b", "", 1, 1, 1), ("t", "b", "1.5", 1, 0, 0), ("t", None, "x", 1, 1, 1)}
    rows = got.collect()
    assert {tuple(r[c] for c in ("k", "p", "v", "n", "nt", "bt")) for r in rows} == want and len(rows) == len(want)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "as string)" not in plan[plan.rindex("Generate") :]
