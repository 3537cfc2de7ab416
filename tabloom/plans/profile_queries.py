"""Profiling and data-quality queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.operators import checks, cube, profile
from tabloom.plans.base import FAMILY, ITEMS, ORDERS, Registry, family_table, items, orders, rounded, t

R = Registry()
_NUMBERS = ("l_quantity", "l_extendedprice", "disc", "tax", "y", "l_linenumber")
_TEXTS = ("l_returnflag", "l_linestatus")


def _stats(c: str, kind: str, value: str = "") -> str:
    v = value or f"CAST({c} AS DOUBLE)"
    return f"""SELECT '{c}' AS "column", '{kind}' AS kind, count(*) AS n_rows, count(v) AS filled, count(DISTINCT v) AS "distinct",
count(DISTINCT v) + CAST(count(v) < count(*) AS INT) AS distinct_with_null, min(v) AS "min", max(v) AS "max", round(avg(v), 4) AS mean,
round(quantile_cont(v, 0.25), 6) AS q25, round(quantile_cont(v, 0.5), 6) AS q50, round(quantile_cont(v, 0.75), 6) AS q75,
CAST(count(*) FILTER (v = 0) AS DOUBLE) AS zeros, CAST(count(*) FILTER (v < 0) AS DOUBLE) AS negatives, NULL::DOUBLE AS mean_length FROM (SELECT {v} AS v FROM {ITEMS})"""


def _text_stats(c: str) -> str:
    return f"""SELECT '{c}' AS "column", 'metin' AS kind, count(*) AS n_rows, count({c}) AS filled, count(DISTINCT {c}) AS "distinct",
count(DISTINCT {c}) AS distinct_with_null, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, avg(length({c})) FROM {ITEMS}"""


_KINDS = {"l_quantity": "ondalik", "l_extendedprice": "ondalik", "disc": "ondalik", "tax": "ondalik", "y": "tam", "l_linenumber": "tam"}


@R.add(" UNION ALL ".join([*(_stats(c, k) for c, k in _KINDS.items()), *(_text_stats(c) for c in _TEXTS)]))
def profile_table(spark: SparkSession, sf: str) -> DataFrame:
    """The exact profile of a table: one shuffle of distinct values for each kind."""
    out = profile.profile(items(spark, sf), [*_NUMBERS, *_TEXTS]).drop("top", "top_count")
    return rounded(rounded(out, "mean", places=4), "q25", "q50", "q75")


@R.add(" UNION ALL ".join(f"""SELECT '{c}' AS "column", r AS rank, v AS value, n FROM (SELECT {c} AS v, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, {c}) AS r FROM lineitem WHERE {c} IS NOT NULL GROUP BY 1) WHERE r <= 10""" for c in _TEXTS))
def profile_top_values(spark: SparkSession, sf: str) -> DataFrame:
    return profile.top_values(t(spark, sf, "lineitem"), _TEXTS)


@R.add("""SELECT 'o_orderstatus' AS "column", o_orderstatus AS value, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY 2""")
def profile_value_lists(spark: SparkSession, sf: str) -> DataFrame:
    df = t(spark, sf, "orders").withColumn("k", F.col("o_orderkey").cast("string"))
    return profile.value_lists(df, ["o_orderstatus", "o_orderpriority", "k"])


@R.add("""SELECT 'l_shipdate' AS "column", min(l_shipdate) AS least, make_timestamp(CAST(quantile_cont(epoch_us(l_shipdate), 0.5) AS BIGINT)) AS median, max(l_shipdate) AS largest FROM lineitem""")
def profile_date_median(spark: SparkSession, sf: str) -> DataFrame:
    return profile.date_median(t(spark, sf, "lineitem"), "l_shipdate")


@R.add("""SELECT * FROM (VALUES ('hedef', 'hedef'), ('o_orderstatus', 'segment'), ('o_orderpriority', 'segment'), ('o_orderkey', 'kimlik')) x("column", role)""")
def profile_roles(spark: SparkSession, sf: str) -> DataFrame:
    """Role candidates: a 0/1 target, a key, segments."""
    df = t(spark, sf, "orders").select("o_orderkey", (F.col("o_custkey") % 2).alias("hedef"), "o_orderstatus", "o_orderpriority", F.round("o_totalprice", -3).alias("price"))
    return profile.roles(profile.profile(df))


@R.add(f"""SELECT count(*) AS n_rows, 3 AS n_columns, round((count(*) - count(disc) + count(*) - count(tax)) / (3.0 * count(*)), 6) AS null_share, 3 AS numeric_columns, 0 AS date_columns,
count(*) - count(DISTINCT (coalesce(disc, -1), coalesce(tax, -1), l_quantity)) AS full_rows, count(*) - count(DISTINCT l_quantity) AS key_rows FROM {ITEMS}""")
def profile_totals(spark: SparkSession, sf: str) -> DataFrame:
    df = items(spark, sf).select("disc", "tax", "l_quantity")
    return rounded(profile.totals(df, profile.profile(df), "l_quantity"), "null_share")


@R.add("""WITH q AS (SELECT quantile_cont(o_totalprice, 0.01) AS a, quantile_cont(o_totalprice, 0.99) AS b FROM orders),
p AS (SELECT CASE WHEN o_totalprice BETWEEN a AND b THEN least(floor((o_totalprice - a) / ((b - a) / 20)), 19) ELSE -1 END AS bin, a, b FROM orders, q)
SELECT CAST(bin AS INT) AS bin, count(*) AS n, round(CASE WHEN bin >= 0 THEN any_value(a + bin * (b - a) / 20) END, 4) AS low, round(CASE WHEN bin >= 0 THEN any_value(a + (bin + 1) * (b - a) / 20) END, 4) AS high FROM p GROUP BY bin""")
def profile_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(profile.histogram(t(spark, sf, "orders"), "o_totalprice"), "low", "high", places=4)


@R.add(f"""WITH q AS (SELECT quantile_cont(amt, [0, 0.01, 0.25, 0.5, 0.75, 0.99, 1]) AS q FROM {ORDERS})
SELECT 'amt' AS "column", round(q[1], 4) AS p0, round(q[2], 4) AS p1, round(q[3], 4) AS p25, round(q[4], 4) AS p50, round(q[5], 4) AS p75, round(q[6], 4) AS p99, round(q[7], 4) AS p100,
count(amt) AS filled, count(*) - count(amt) AS nulls, count(DISTINCT amt) AS "distinct", round(avg(amt), 4) AS mean,
count(*) FILTER (amt < q[3] - 1.5 * (q[5] - q[3]) OR amt > q[5] + 1.5 * (q[5] - q[3])) AS outliers FROM {ORDERS}, q GROUP BY q""")
def profile_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(profile.distribution(orders(spark, sf), "amt"), *[f"p{i}" for i in (0, 1, 25, 50, 75, 99, 100)], "mean", places=4)


@R.add("""WITH c AS (SELECT p_type AS v, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, p_type) AS r FROM part GROUP BY 1)
SELECT v AS value, n FROM c WHERE r <= 3 UNION ALL SELECT NULL, CAST(sum(n) AS BIGINT) FROM c WHERE r > 3 HAVING count(*) > 0""")
def profile_categories(spark: SparkSession, sf: str) -> DataFrame:
    return profile.category_distribution(t(spark, sf, "part"), "p_type", 3)


@R.add(f"""WITH s AS (SELECT unnest([1 - count(disc) / count(*), 1 - count(tax) / count(*), 0, 0]) AS s FROM {ITEMS})
SELECT CASE WHEN s <= 0 THEN 'none' WHEN s <= 0.05 THEN 'little' WHEN s <= 0.5 THEN 'medium' ELSE 'excessive' END AS bucket, count(*) AS columns FROM s GROUP BY 1""")
def profile_missing(spark: SparkSession, sf: str) -> DataFrame:
    return profile.missing_buckets(profile.profile(items(spark, sf), ["disc", "tax", "l_quantity", "l_returnflag"]))


@R.add("""SELECT 'o_orderstatus' AS "column", v AS value, n FROM (SELECT o_orderstatus AS v, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, o_orderstatus) AS r FROM orders GROUP BY 1) WHERE r <= 3""")
def profile_masked(spark: SparkSession, sf: str) -> DataFrame:
    """Raw values only of columns that can't tell on a person: ids and long texts stay hidden."""
    df = t(spark, sf, "orders").select("o_orderstatus", F.concat(F.lit("K"), F.col("o_orderkey").cast("string")).alias("k"), F.repeat("o_orderpriority", 20).alias("long"))
    return profile.masked_values(df, ["o_orderstatus", "k", "long"])


# ---- checks ----------------------------------------------------------------------------------


def _checked(spark: SparkSession, sf: str) -> DataFrame:
    """Line items with a column for every finding."""
    li, k = items(spark, sf), F.col("l_orderkey")
    return li.select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_shipdate", "y", "tr",
        F.concat_ws("", F.year("l_shipdate")).alias("p"),
        F.when(k % 3 == 0, F.col("l_quantity")).alias("thin"), F.lit(7).alias("same"), (k * 10 + F.col("l_linenumber")).alias("rid"),
        F.when(k % 200 == 0, 1).otherwise(0).alias("almost"), F.when(k % 20 == 0, F.lit(-99.0)).otherwise(F.col("l_quantity")).alias("coded"),
        F.when(k % 5 != 0, F.when(k % 500 == 1, F.lit(999999.0)).otherwise(F.col("l_quantity"))).alias("mixed"),
        F.when(k % 30 == 0, F.col("l_quantity")).otherwise(F.lit(0.0)).alias("zeros"),
        F.when(k % 1000 == 7, F.col("l_quantity") * 1e6).otherwise(F.col("l_quantity")).alias("far"),
        (F.col("l_quantity") - 2).alias("days"),
        F.when(F.year("l_shipdate") != 1997, F.col("l_quantity")).alias("gap"),
        F.when((F.year("l_shipdate") < 1998) | (k % 2 == 0), F.col("l_quantity")).alias("jump"),
        F.when(F.year("l_shipdate") < 1999, F.col("l_extendedprice")).otherwise(F.col("l_extendedprice") * 100).alias("drift"),
        F.element_at(F.array(F.lit(" NULL"), F.lit("Bilinmiyor"), F.lit("?"), F.lit("dolu")), (k % 4 + 1).cast("int")).alias("said"),
        F.element_at(F.array(F.lit("İstanbul"), F.lit("ISTANBUL "), F.lit("Ankara"), F.lit("istanbul"), F.lit("İstanbul")), (k % 5 + 1).cast("int")).alias("city"),
        F.when(k % 100 == 0, F.lit("9999-12-31")).otherwise(F.date_format("l_shipdate", "yyyy-MM-dd")).alias("day"),
        F.when(k % 9 == 0, F.date_add(F.last_day(F.col("l_shipdate").cast("date")), 3)).otherwise(F.col("l_shipdate").cast("date")).alias("late"),
        F.date_format("l_shipdate", "yyyyMM").alias("ym"),
        (F.col("y") * 100 + F.col("l_quantity")).alias("leak"), (F.col("l_quantity") * 100).alias("times"), F.col("l_quantity").cast("int").alias("copy"),
    )


_C = f"""(SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_shipdate, y, tr, CAST(year(l_shipdate) AS VARCHAR) AS p,
CASE WHEN l_orderkey % 3 = 0 THEN l_quantity END AS thin, 7 AS same, l_orderkey * 10 + l_linenumber AS rid, CASE WHEN l_orderkey % 200 = 0 THEN 1 ELSE 0 END AS almost,
CASE WHEN l_orderkey % 20 = 0 THEN -99.0::DOUBLE ELSE l_quantity END AS coded, CASE WHEN l_orderkey % 5 <> 0 THEN CASE WHEN l_orderkey % 500 = 1 THEN 999999.0::DOUBLE ELSE l_quantity END END AS mixed,
CASE WHEN l_orderkey % 30 = 0 THEN l_quantity ELSE 0 END AS zeros, CASE WHEN l_orderkey % 1000 = 7 THEN l_quantity * 1e6 ELSE l_quantity END AS far, l_quantity - 2 AS days,
CASE WHEN year(l_shipdate) <> 1997 THEN l_quantity END AS gap, CASE WHEN year(l_shipdate) < 1998 OR l_orderkey % 2 = 0 THEN l_quantity END AS jump,
CASE WHEN year(l_shipdate) < 1999 THEN l_extendedprice ELSE l_extendedprice * 100 END AS drift,
[' NULL', 'Bilinmiyor', '?', 'dolu'][l_orderkey % 4 + 1] AS said, ['İstanbul', 'ISTANBUL ', 'Ankara', 'istanbul', 'İstanbul'][l_orderkey % 5 + 1] AS city,
CASE WHEN l_orderkey % 100 = 0 THEN '9999-12-31' ELSE strftime(l_shipdate, '%Y-%m-%d') END AS day,
CASE WHEN l_orderkey % 9 = 0 THEN last_day(CAST(l_shipdate AS DATE)) + 3 ELSE CAST(l_shipdate AS DATE) END AS late, y * 100 + l_quantity AS leak FROM {ITEMS})"""


@R.add(f"""WITH s AS (SELECT unnest([{{'c': 'thin', 'n': count(*), 'f': count(thin), 'd': count(DISTINCT thin), 't': 0, 'k': 'ondalik'}}, {{'c': 'same', 'n': count(*), 'f': count(*), 'd': 1, 't': count(*), 'k': 'tam'}},
{{'c': 'rid', 'n': count(*), 'f': count(*), 'd': count(DISTINCT rid), 't': 1, 'k': 'tam'}}, {{'c': 'almost', 'n': count(*), 'f': count(*), 'd': 2, 't': count(*) FILTER (almost = 0), 'k': 'tam'}},
{{'c': 'city', 'n': count(*), 'f': count(*), 'd': 4, 't': 0, 'k': 'metin'}}]) AS s FROM {_C}), r AS (SELECT s.c AS "column", unnest([CASE WHEN s.n - s.f > 0.5 * s.n THEN 'too_null' END, CASE WHEN s.d + CAST(s.f < s.n AS INT) <= 1 THEN 'constant' END,
CASE WHEN s.k <> 'ondalik' AND s.d > 0.95 * s.n AND s.d > 100 THEN 'id_like' END, CASE WHEN s.k = 'metin' AND s.d > 50 THEN 'high_cardinality' END, CASE WHEN greatest(s.t, s.n - s.f) >= 0.99 * s.n THEN 'near_constant' END]) AS finding FROM s)
SELECT * FROM r WHERE finding IS NOT NULL""")
def check_columns(spark: SparkSession, sf: str) -> DataFrame:
    return checks.column_rules(profile.profile(_checked(spark, sf), ["thin", "same", "rid", "almost", "city"]))


@R.add(f"""SELECT 'coded' AS "column", -99 AS code, count(*) FILTER (coded = -99) AS n, round(count(*) FILTER (coded = -99) / count(*), 6) AS share, 0 AS nulls, FALSE AS mixed FROM {_C} HAVING count(*) FILTER (coded = -99) > 0.01 * count(*)
UNION ALL SELECT 'mixed', 999999, count(*) FILTER (mixed = 999999), round(count(*) FILTER (mixed = 999999) / count(mixed), 6), count(*) - count(mixed), count(*) FILTER (mixed = 999999) <= 0.01 * count(mixed) FROM {_C}""")
def check_hidden_missing(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(checks.hidden_missing(_checked(spark, sf), ["coded", "mixed", "l_quantity", "far"]), "share")


@R.add(f"""SELECT 'zeros' AS "column", count(*) FILTER (zeros = 0) AS n, round(count(*) FILTER (zeros = 0) / count(*), 6) AS share FROM {_C} HAVING count(*) FILTER (zeros = 0) BETWEEN 0.95 * count(*) AND 0.99 * count(*)""")
def check_zeros(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(checks.zero_heavy(_checked(spark, sf), ["zeros", "almost", "l_quantity"]), "share")


@R.add(f"""SELECT 'far' AS "column", max(far) AS most, round(quantile_cont(far, 0.99), 4) AS p99 FROM {_C} HAVING max(far) > 100 * quantile_cont(far, 0.99)""")
def check_extremes(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(checks.extremes(_checked(spark, sf), ["far", "l_quantity"]), "p99", places=4)


@R.add(f"""SELECT 'days' AS "column", count(*) AS n, min(days) AS least FROM {_C} WHERE days < 0 HAVING count(*) > 0""")
def check_negatives(spark: SparkSession, sf: str) -> DataFrame:
    return checks.unexpected_negatives(_checked(spark, sf), {"days": "gün sayısı", "l_quantity": "Miktar"})


@R.add(f"""SELECT 'gap' AS "column", p AS period, 'empty' AS finding FROM {_C} GROUP BY p HAVING count(gap) = 0""")
def check_period_gaps(spark: SparkSession, sf: str) -> DataFrame:
    return checks.period_gaps(_checked(spark, sf), ["gap", "l_quantity", "same"], "p")


@R.add(f"""WITH s AS (SELECT p, 1 - count(jump) / count(*) AS s FROM {_C} GROUP BY p), l AS (SELECT p, s, lag(p) OVER (ORDER BY p) AS bp, lag(s) OVER (ORDER BY p) AS bs FROM s)
SELECT 'jump' AS "column", bp AS before, p AS "after", round(bs, 6) AS share_before, round(s, 6) AS share_after FROM l WHERE abs(s - bs) > 0.2 ORDER BY abs(s - bs) DESC, p LIMIT 1""")
def check_missing_jumps(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(checks.missing_jumps(_checked(spark, sf), ["jump", "l_quantity"], "p"), "share_before", "share_after")


@R.add(f"""SELECT p AS period, CASE WHEN l_orderkey % 11 <> 0 THEN y END AS value, count(*) AS n, round(CASE WHEN l_orderkey % 11 <> 0 THEN count(*) / sum(count(*)) FILTER (value IS NOT NULL) OVER (PARTITION BY p) END, 6) AS share
FROM {_C} GROUP BY 1, 2, l_orderkey % 11 <> 0""".replace("SELECT p AS period, CASE WHEN l_orderkey % 11 <> 0 THEN y END AS value, count(*) AS n, round(CASE WHEN l_orderkey % 11 <> 0 THEN count(*) / sum(count(*)) FILTER (value IS NOT NULL) OVER (PARTITION BY p) END, 6) AS share", "WITH g AS (SELECT p, CASE WHEN l_orderkey % 11 <> 0 THEN y END AS v, count(*) AS n").replace(" GROUP BY 1, 2, l_orderkey % 11 <> 0", " GROUP BY 1, 2) SELECT p AS period, v AS value, n, round(CASE WHEN v IS NOT NULL THEN n / sum(CASE WHEN v IS NOT NULL THEN n END) OVER (PARTITION BY p) END, 6) AS share FROM g"))
def check_target(spark: SparkSession, sf: str) -> DataFrame:
    df = _checked(spark, sf).withColumn("v", F.when(F.col("l_orderkey") % 11 != 0, F.col("y")))
    return rounded(checks.target_summary(df, "v", "p"), "share")


@R.add(f"""SELECT 'said' AS "column", said AS value, count(*) AS n FROM {_C} WHERE said <> 'dolu' GROUP BY 2""")
def check_empty_texts(spark: SparkSession, sf: str) -> DataFrame:
    return checks.empty_texts(_checked(spark, sf), ["said", "city"])


@R.add(f"""SELECT 'city' AS "column", city AS value, count(*) AS n, 'İstanbul' AS target FROM {_C} WHERE city IN ('istanbul') GROUP BY 2 UNION ALL SELECT 'city', 'ISTANBUL ', count(*), 'İstanbul' FROM {_C} WHERE city = 'ISTANBUL '""")
def check_spellings(spark: SparkSession, sf: str) -> DataFrame:
    """Turkish letters fold: dotted and dotless i, case, spaces."""
    return checks.spelling_variants(_checked(spark, sf), ["city"])


@R.add("""SELECT 'day' AS "column", 'text' AS how UNION ALL SELECT 'late', 'type'""")
def check_date_columns(spark: SparkSession, sf: str) -> DataFrame:
    return checks.date_columns(_checked(spark, sf), ["day", "late", "city", "l_quantity"])


@R.add(f"""SELECT 'day' AS "column", day AS value, count(*) AS n FROM {_C} WHERE day = '9999-12-31' GROUP BY 2""")
def check_sentinel_dates(spark: SparkSession, sf: str) -> DataFrame:
    return checks.sentinel_dates(_checked(spark, sf), ["day", "late"])


@R.add(f"""SELECT 'late' AS "column", count(*) FILTER (b) AS n, round(avg(CAST(b AS DOUBLE)), 6) AS share, strftime(max(late) FILTER (b), '%Y-%m-%d') AS latest FROM (SELECT late, late > last_day(CAST(l_shipdate AS DATE)) AS b FROM {_C}) HAVING count(*) FILTER (b) > 0""")
def check_late_dates(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(checks.late_dates(_checked(spark, sf), ["late", "day"], "ym"), "share")


@R.add(f"""WITH q AS (SELECT p, count(*) AS m, quantile_cont(drift, 0.25) AS a, quantile_cont(drift, 0.5) AS b, quantile_cont(drift, 0.75) AS c FROM {_C} WHERE drift <> 0 GROUP BY p),
l AS (SELECT *, lag(p) OVER w AS bp, lag(m) OVER w AS bm, a / lag(a) OVER w AS ra, b / lag(b) OVER w AS rb, c / lag(c) OVER w AS rc, lag(b) OVER w AS bb FROM q WINDOW w AS (ORDER BY p))
SELECT 'drift' AS "column", bp AS before, p AS "after", round(bb, 4) AS median_before, round(b, 4) AS median_after, round(least(ra, rb, rc), 4) AS factor FROM l WHERE m >= 30 AND bm >= 30 AND least(ra, rb, rc) >= 10""")
def check_drift(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(checks.value_drift(_checked(spark, sf), ["drift", "l_quantity"], "p"), "median_before", "median_after", "factor", places=4)


@R.add(f"""WITH v AS (SELECT leak AS x, count(*) FILTER (y = 1) AS b, count(*) FILTER (y = 0) AS g FROM {_C} WHERE tr GROUP BY 1), c AS (SELECT *, coalesce(sum(g) OVER (ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gb FROM v),
a AS (SELECT sum(b * (gb + g / 2.0)) / (sum(b) * sum(g)) AS auc FROM c) SELECT 'leak' AS "column", round(greatest(auc, 1 - auc), 6) AS auc FROM a WHERE greatest(auc, 1 - auc) >= 0.95""")
def check_separators(spark: SparkSession, sf: str) -> DataFrame:
    df = _checked(spark, sf).where("tr")
    return rounded(checks.target_separators(df, ["leak", "l_extendedprice", "city"], "y"), "auc")


@R.add("""SELECT 'l_quantity' AS "column", 'copy' AS copy""")
def check_identical(spark: SparkSession, sf: str) -> DataFrame:
    return checks.identical_columns(_checked(spark, sf), ["l_quantity", "copy", "times", "thin"], ["l_orderkey", "l_linenumber"])


@R.add("""SELECT 'l_quantity' AS "column", 'times' AS copy, 1.0 AS r, 'kat' AS relation""")
def check_near_copies(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(checks.near_copies(_checked(spark, sf), ["l_quantity", "times", "l_extendedprice"]), "r")


@R.add(f"""SELECT 'TXN_CNT_L360D' AS "column", 'TXN_CNT_L30D' AS other, 'artan' AS kind, count(*) FILTER (TXN_CNT_L360D > TXN_CNT_L30D) AS n, round(count(*) FILTER (TXN_CNT_L360D > TXN_CNT_L30D) / count(*), 6) AS share FROM {FAMILY}""")
def check_windows(spark: SparkSession, sf: str) -> DataFrame:
    """A long window never falls short of the short one; the pair turned round gives findings."""
    f = family_table(spark, sf)
    return rounded(checks.window_consistency(f, [("TXN_CNT_L30D", "TXN_CNT_L90D", "artan"), ("TXN_CNT_L360D", "TXN_CNT_L30D", "artan")]), "share")


@R.add(f"""SELECT 'TXN_AMT_L90D' AS "column", 'TXN_CNT_L30D' AS other, 'adet_tutar' AS kind, count(*) FILTER (TXN_CNT_L30D = 0 AND TXN_AMT_L90D <> 0) AS n, round(count(*) FILTER (TXN_CNT_L30D = 0 AND TXN_AMT_L90D <> 0) / count(TXN_AMT_L90D), 6) AS share FROM {FAMILY}""")
def check_amounts(spark: SparkSession, sf: str) -> DataFrame:
    f = family_table(spark, sf)
    return rounded(checks.amount_count(f, [("TXN_CNT_L30D", "TXN_AMT_L30D"), ("TXN_CNT_L30D", "TXN_AMT_L90D")], [("TXN_AMT_L360D", "TXN_AMT_L30D")]), "share")


@R.add("""SELECT 'l_quantity' AS "column", 'integral' AS finding UNION ALL SELECT 'third', 'decimals'""")
def check_precision(spark: SparkSession, sf: str) -> DataFrame:
    df = t(spark, sf, "lineitem").select("l_quantity", "l_extendedprice", (F.col("l_extendedprice") / 3).alias("third"))
    return checks.decimal_precision(df, ["l_quantity", "l_extendedprice", "third"])


_ADVISED = ["l_quantity", "almost", "gap", "jump", "drift", "far", "days", "said", "city", "thin"]
_ADVICE = f"""WITH c AS {_C}, n AS (SELECT count(DISTINCT p) AS d, count(*) AS t FROM c), tr AS (SELECT avg(y) FILTER (almost = 1) AS a, avg(y) FILTER (almost = 0) AS b, count(*) FILTER (almost = 1) AS m FROM c WHERE tr),
g AS (SELECT p, count(gap) AS f FROM c GROUP BY 1), r AS (SELECT p, f, row_number() OVER (ORDER BY p) AS i FROM g), e AS (SELECT count(*) AS m, max(i) AS l FROM r WHERE f = 0),
s AS (SELECT k, p, f, lag(f) OVER (PARTITION BY k ORDER BY p) AS b FROM (SELECT 'jump' AS k, p, 1 - count(jump) / count(*) AS f FROM c GROUP BY p UNION ALL SELECT 'gap', p, 1 - count(gap) / count(*) FROM c GROUP BY p)),
j AS (SELECT * FROM s WHERE abs(f - b) > 0.2 QUALIFY row_number() OVER (PARTITION BY k ORDER BY abs(f - b) DESC, p) = 1),
q AS (SELECT p, count(*) AS m, quantile_cont(drift, 0.25) AS a, quantile_cont(drift, 0.5) AS b, quantile_cont(drift, 0.75) AS c FROM c WHERE drift <> 0 GROUP BY p),
l AS (SELECT *, least(a / lag(a) OVER w, b / lag(b) OVER w, c / lag(c) OVER w) AS f, b / lag(b) OVER w AS rb, lag(m) OVER w AS bm FROM q WINDOW w AS (ORDER BY p)), z AS (SELECT f, rb FROM l WHERE m >= 30 AND bm >= 30 AND f >= 10 ORDER BY f DESC LIMIT 1)
SELECT 'almost' AS "column", 'baskin' AS finding, CASE WHEN m < 30 OR greatest(a, b) = 0 OR (least(a, b) > 0 AND greatest(a, b) / least(a, b) < 1.5) THEN 'cikar' ELSE 'tut' END AS advice,
 CASE WHEN m < 30 THEN 'az_satir' WHEN greatest(a, b) = 0 THEN 'olay_yok' WHEN least(a, b) = 0 OR greatest(a, b) / least(a, b) >= 1.5 THEN 'ayirir' ELSE 'ayirmaz' END AS reason, round(a, 6) AS figure, round(b, 6) AS against FROM tr WHERE (SELECT avg(CAST(almost = 0 AS DOUBLE)) FROM c) >= 0.99
UNION ALL SELECT 'gap', 'donem', CASE WHEN l = m AND m <= 0.35 * d AND l <> d THEN 'tut' ELSE 'cikar' END, CASE WHEN l = d THEN 'son_donem' WHEN l = m AND m <= 0.35 * d THEN 'ilk_donemler' ELSE 'tutarsiz' END, m, d FROM e, n WHERE m > 0
UNION ALL SELECT k, 'sicrama', CASE WHEN f > b AND f >= 0.5 THEN 'cikar' ELSE 'tut' END, CASE WHEN f <= b THEN 'azaldi' WHEN f >= 0.5 THEN 'asti' ELSE 'artti' END, round(b, 6), round(f, 6) FROM j
UNION ALL SELECT 'drift', 'kayma', CASE WHEN abs(log10(f) - round(log10(f))) <= 0.05 THEN 'cikar' ELSE 'tut' END, CASE WHEN abs(log10(f) - round(log10(f))) <= 0.05 THEN 'birim' ELSE 'degisim' END, round(f, 6), round(rb, 6) FROM z
UNION ALL SELECT 'far', 'uc', 'kirp', 'kat', max(far), round(quantile_cont(far, 0.99), 6) FROM c HAVING max(far) > 100 * quantile_cont(far, 0.99)
UNION ALL SELECT 'days', 'negatif', CASE WHEN count(*) FILTER (days < 0) < 0.05 * count(*) THEN 'negatif_bos' ELSE 'birak' END, CASE WHEN count(*) FILTER (days < 0) < 0.05 * count(*) THEN 'az' ELSE 'sistematik' END, count(*) FILTER (days < 0), min(days) FROM c HAVING count(*) FILTER (days < 0) > 0
UNION ALL SELECT k, 'ondalik', 'tam_sayi', 'tam', 4, f FROM (SELECT unnest(['l_quantity', 'gap', 'jump', 'days', 'thin', 'far']) AS k, unnest([count(l_quantity), count(gap), count(jump), count(days), count(thin), count(far)]) AS f FROM c)
UNION ALL SELECT 'drift', 'ondalik', 'yuvarla', 'fazla', 4, count(drift) FROM c HAVING bool_or(round(drift, 4) <> drift)
UNION ALL SELECT 'said', 'metin_bos', 'metin_bos_bayrak', 'cok', count(*) FILTER (said <> 'dolu'), round(count(*) FILTER (said <> 'dolu') / count(*), 6) FROM c
UNION ALL SELECT 'city', 'yazim', 'tek_yazim', 'yazimlar', 1, count(*) FILTER (city IN ('istanbul', 'ISTANBUL ')) FROM c"""


@R.add(_ADVICE)
def advice_findings(spark: SparkSession, sf: str) -> DataFrame:
    """Keep, drop or mend: what the battery finds on a table, with the numbers that decide, from one count cube."""
    out = cube.keep_or_drop(_checked(spark, sf), _ADVISED, "p", "y", F.col("tr"), {"days": "gün sayısı"})
    return rounded(out, "figure", "against")
