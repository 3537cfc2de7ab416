"""Spellings one by one: conversions, periods, personal data, dictionaries, names."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.functions import periods
from tabloom.operators import convert, dictionary, features, profile, select

_CASES = [
    ("sayisal_nokta", "1,234.50", 1234.5, True), ("sayisal_nokta", "1,23.5", None, False), ("sayisal_nokta", "12,34", None, False), ("sayisal_nokta", "-7.25", -7.25, True),
    ("sayisal_virgul", "1.234,50", 1234.5, True), ("sayisal_virgul", "1.23,5", None, False),
    ("tarih_ymd", "2024-01-31", 20240131.0, True), ("tarih_ymd", "2024-13-01", None, False),
    ("tarih_dmy", "31.01.2024", 20240131.0, True), ("tarih_dmy", "31/01/2024", None, False),
    ("tarih_ymd8", "20240131", 20240131.0, True), ("tarih_ymd8", "20241301", None, False),
    ("tarih_ym6", "202401", 20240101.0, True), ("donem_ym6", "202401", 202401.0, True), ("donem_ym6", "202413", None, False),
    ("donem_ymd8", "20240229", 20240229.0, True), ("donem_ymd8", "20230229", None, False),
    ("kategorik_metin", "12.0", 12.0, True), ("kategorik_ay", "2024-05-06", 202405.0, True), ("kategorik_yil", "06.05.2024", 2024.0, True), ("sayisal_ymd8", "2024-05-06", 20240506.0, True),
]


@pytest.mark.parametrize(("code", "raw", "value", "fits"), _CASES)
def test_conversion(spark, code, raw, value, fits):
    c = convert.convert(F.col("raw"), code, T.StringType())
    as_number = F.date_format(c, "yyyyMMdd").try_cast("double") if code.startswith("tarih") else F.regexp_replace(c.cast("string"), "-(?=[0-9]{2}$)", "").try_cast("double")
    got = spark.createDataFrame([(raw,)], "raw string").select(as_number).first()[0]
    assert got == value and (got is not None) == fits


@pytest.mark.parametrize(("p", "m"), [("202501", 24301), ("2024M12", 24300), ("01/2025", 24301), ("20250131", 24301), ("2025-03-05", 24303)])
def test_period(spark, p, m):
    df = spark.createDataFrame([(p,), (" NULL ",)], "p string")
    assert [r.m for r in df.select(periods.month_index(df, "p", periods.decide(df, "p")).alias("m")).where("m IS NOT NULL").collect()] == [m]


def test_personal_data(spark):
    values = ["a@b.co", "x y", "TR000000000000000000000001", "05321234567", "+90 532 123 45 67", "10000000146", "10000000147", "1234567812345678", "10000000146.0"]
    got = {r.pattern: (r.matching, r.filled, r.flagged) for r in profile.personal_data(spark.createDataFrame([(v,) for v in values], "v string"), ["v"]).collect()}
    assert got == {"eposta": (1, 9, False), "iban": (1, 9, False), "telefon": (2, 9, False), "kart": (1, 9, False), "kimlik": (2, 9, False)}


def test_names_as_rows_and_as_lists(spark):
    """The rules on tables of names give what the rules on a list give."""
    names = ["TXN_OUT_AMT_L30D", "TXN_OUT_AMT_L90D", "TXN_IN_AMT_L30D", "TXN_OUT_CNT_L30D", "L7D_TXN_TOT_AMT", "CARD_LIMIT_NEXT3M", "customerAge", "x__y", "Y_SON3A"]
    df = spark.createDataFrame([(n,) for n in [*names, None]], "name string")
    assert {(r.first_, r.second): r.n for r in dictionary.adjacent_table(df).withColumnRenamed("first", "first_").collect()} == dictionary.adjacent(names)
    assert {r.pattern: r.n for r in dictionary.pattern_table(df).collect()} == {p: n for p, (n, _) in dictionary.period_patterns(names).items()}
    rows = df.where("name IS NOT NULL").select("name", dictionary.looks_ahead(F.col("name")).alias("a"), dictionary.standard(F.col("name")).alias("s")).collect()
    assert [r.name for r in rows if r.a] == dictionary.future_columns(names) and {r.name: r.s for r in rows} == {n: dictionary.standard_name(n) for n in names}


def test_families_and_gate():
    names = ["TXN_OUT_AMT_L30D", "TXN_OUT_AMT_L90D", "TXN_IN_AMT_L30D", "TXN_OUT_CNT_L30D", "CUSTOMER_AGE", "CUSTMER_AGE"]
    assert {k: len(v) for k, v in features.families(names).items()} == {"TXN_OUT_AMT": 2}
    assert {(a, b) for _, a, b in features.pairs(names)} == {("TXN_IN_AMT_L30D", "TXN_OUT_AMT_L30D"), ("TXN_OUT_AMT_L30D", "TXN_OUT_CNT_L30D")}
    assert dictionary.similar_tokens(names) == [["CUSTMER", "CUSTOMER"]] and features.estimate(3, ["oran", "fark"]) == 4
    assert select.gate({"gini_test": 0.45, "ks_test": 0.35, "gini_drop": 0.05, "psi": 0.2, "gini_oot": 0.4, "ks_oot": 0.3})[0] == "kosullu"


def test_facts_evaluate_a_column_once(spark):
    """However many facts are asked, an input expression stands once in the plan; texts that can't be dates aren't parsed, those that can are."""
    df = spark.sql("SELECT date_format(make_date(2024, 1, id + 1), 'yyyy-MM-dd') AS d, concat('0', id) AS z, CAST(id AS DOUBLE) AS x, id AS A_KOD, CAST(NULL AS STRING) AS none FROM range(9)")
    plan = convert.text_facts(df, df.columns, ["A_KOD"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("date_format(") == 1
    got = dict(convert.facts(df, df.columns))
    assert [got[c]["filled"] for c in df.columns] == [9, 9, 9, 9, 0]
    assert (got["d"]["bad_date"], got["z"]["bad_date"], got["z"]["leading_zero"], got["x"]["bad_number"], got["A_KOD"]["distinct"]) == (0, 9, 9, 0, 9)
    assert {r.column: r.code for r in convert.suggestions(df, df.columns).collect()} == {"d": "tarih_ymd", "A_KOD": "kategorik_metin"}
    one = spark.createDataFrame([("2024-001-01", "1.001.2024")], "a string, b string")
    made = one.select(convert.convert(F.col("a"), "tarih_ymd", T.StringType()).isNotNull(), convert.convert(F.col("b"), "tarih_dmy", T.StringType()).isNotNull()).first()
    assert tuple(made) == (True, True)
