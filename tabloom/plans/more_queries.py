"""Column surgery, names, dictionaries' upkeep, model queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.operators import binning, checks, columns, features, merge, profile, recipe, remedies, select, split
from tabloom.operators.columns import Roles
from tabloom.plans.base import ITEMS, ORDERS, Registry, items, orders, rounded, t
from tabloom.sources import store

R = Registry()


@R.add(f"""SELECT l_orderkey AS anahtar, y, l_quantity AS miktar, count(*) AS n FROM {ITEMS} WHERE tr AND l_partkey % 3 <> 0 AND y IS NOT NULL GROUP BY 1, 2, 3""")
def columns_surgery(spark: SparkSession, sf: str) -> DataFrame:
    """Drops that spare protected columns, approved renames, a set's rows with a known target."""
    df = items(spark, sf).withColumn(split.SPLIT, F.when(F.col("tr"), "train").otherwise("test")).withColumn("y2", F.when(F.col("l_partkey") % 3 != 0, F.col("y")))
    df = columns.with_target(columns.of_sets(df, "train"), "y2")
    out = columns.rename(columns.drop(df, ["l_tax", "l_orderkey", "tax", "y2"], Roles(ident="l_orderkey")), {"l_orderkey": "anahtar", "l_quantity": "miktar"})
    return out.groupBy("anahtar", "y", "miktar").agg(F.count(F.lit(1)).alias("n"))


@R.add(f"""SELECT round(sum(coalesce(disc, (SELECT median(disc) FROM {ITEMS} WHERE tr))), 4) AS disc, round(sum(coalesce(tax, (SELECT median(tax) FROM {ITEMS} WHERE tr))), 4) AS tax, count(*) AS n FROM {ITEMS}""")
def columns_base(spark: SparkSession, sf: str) -> DataFrame:
    """The analytic base set: constant columns dropped, numbers filled with train medians."""
    df = items(spark, sf).select("l_orderkey", "y", "tr", "disc", "tax", F.lit(1).alias("same"))
    found = [tuple(r) for r in checks.column_rules(profile.profile(df, ["same", "disc"])).collect()]
    out = columns.analytic_base(columns.drop_defective(df, found, Roles(target="y")), F.col("tr"), Roles(target="y", ident="l_orderkey"))
    return rounded(out.agg(F.sum("disc").alias("disc"), F.sum("tax").alias("tax"), F.count(F.lit(1)).alias("n")), "disc", "tax", places=4)


@R.add(f"""SELECT 'binary' AS kind, count(DISTINCT y) AS "distinct", round(avg(coalesce(CAST(y > 0 AS DOUBLE), 0)), 6) AS event_rate, count(*) - count(y) AS nulls FROM (SELECT CASE WHEN l_partkey % 5 <> 0 THEN y END AS y FROM {ITEMS})""")
def target_definition(spark: SparkSession, sf: str) -> DataFrame:
    """The event rate has all rows below the line, those without a target, too."""
    df = items(spark, sf).select(F.when(F.col("l_partkey") % 5 != 0, F.col("y")).alias("y"))
    return rounded(columns.target_kind(df, "y"), "event_rate")


@R.add("""SELECT min(strftime(o_orderdate, '%Y%m')) AS first, max(strftime(o_orderdate, '%Y%m')) AS last, count(DISTINCT strftime(o_orderdate, '%Y%m')) AS n_periods, TRUE AS serves FROM orders""")
def period_definition(spark: SparkSession, sf: str) -> DataFrame:
    """Periods written month first, put in time order."""
    df = t(spark, sf, "orders").select(F.date_format("o_orderdate", "MM/yyyy").alias("p"))
    turn = lambda c: F.concat(F.substring(c, 4, 4), F.substring(c, 1, 2))
    return columns.period_summary(df, "p").select(turn("first").alias("first"), turn("last").alias("last"), "n_periods", "serves")


@R.add(f"""WITH v AS (SELECT l_quantity AS x FROM {ITEMS}), q AS (SELECT quantile_cont(x, [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]) AS q, skewness(x) AS s FROM v)
SELECT 'l_quantity' AS "column", q[1] AS p1, q[2] AS p5, q[3] AS p25, q[4] AS p50, q[5] AS p75, q[6] AS p95, q[7] AS p99, round(avg(CAST(x < q[3] - 3 * (q[5] - q[3]) OR x > q[5] + 3 * (q[5] - q[3]) AS DOUBLE)), 6) AS outlier_share, round(any_value(s), 6) AS skew FROM v, q GROUP BY q""")
def variable_detail(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(binning.variable_detail(items(spark, sf), ["l_quantity"]), "outlier_share", "skew")


@R.add(f"""WITH b AS (SELECT l_orderkey, l_linenumber, l_returnflag AS k, y, CAST(('0x' || substr(md5(l_orderkey || '|' || l_linenumber), 1, 8))::BIGINT % 5 AS INT) AS f FROM {ITEMS} WHERE tr),
c AS (SELECT k, f, count(*) AS n, sum(y) AS s FROM b GROUP BY 1, 2), a AS (SELECT k, sum(n) AS n, sum(s) AS s FROM c GROUP BY 1)
SELECT k, f, count(*) AS n_rows, round(any_value((a.s - c.s) / (a.n - c.n)), 6) AS rate FROM b JOIN a USING (k) JOIN c USING (k, f) GROUP BY 1, 2""")
def encode_rate(spark: SparkSession, sf: str) -> DataFrame:
    """Out-of-fold target rates of a category, without smoothing."""
    df = items(spark, sf).where("tr").withColumnRenamed("l_returnflag", "k")
    out = features.encode(df, F.lit(True), "k", "y", ["l_orderkey", "l_linenumber"], ("te",), 0.0)
    return rounded(out.groupBy("k", features.fold_of(["l_orderkey", "l_linenumber"]).alias("f")).agg(F.count(F.lit(1)).alias("n_rows"), F.first("k__TE").alias("rate")), "rate")


@R.add(f"""WITH g AS (SELECT quantile_cont(l_quantity, [i / 100.0 FOR i IN range(101)]) AS g FROM {ITEMS} WHERE tr)
SELECT l_quantity, count(*) AS n, round(any_value(ln(1 + greatest(l_quantity, 0))), 6) AS lg, round(any_value(len(list_filter(g, lambda x: x <= l_quantity)) / 101.0), 6) AS rk, round(any_value(least(greatest(l_quantity, g[2]), g[100])), 6) AS wn FROM {ITEMS}, g GROUP BY 1""")
def features_scaled(spark: SparkSession, sf: str) -> DataFrame:
    """Logarithm, grid rank and winsor, from a 101-point train grid."""
    df = items(spark, sf)
    grid = features.learn_grid(df.where("tr"), ["l_quantity"], [i / 100 for i in range(101)])["l_quantity"]
    lg, rk, wn = features.scaled("l_quantity", grid).values()
    out = features.add(df, {"lg": lg, "rk": rk, "wn": wn}).groupBy("l_quantity").agg(F.count(F.lit(1)).alias("n"), *[F.first(c).alias(c) for c in ("lg", "rk", "wn")])
    return rounded(out, "lg", "rk", "wn")


@R.add(f"""SELECT CASE WHEN disc IS NULL THEN NULL WHEN disc <= 0.05 THEN 0.0 ELSE 1.0 END AS o, count(*) AS n FROM {ITEMS} GROUP BY 1""")
def binning_ordinal(spark: SparkSession, sf: str) -> DataFrame:
    """Bin labels as ordinals; "Eksik" has no place in the order."""
    df = items(spark, sf).withColumn("a", binning.apply_cuts("disc", [0.05]))
    return df.groupBy(binning.ordinal("a", binning.labels([0.05])).alias("o")).agg(F.count(F.lit(1)).alias("n"))


@R.add(f"""SELECT o_custkey, mon, round(sum(amt), 2) AS total, count(amt) AS filled, count(*) AS n_rows FROM {ORDERS} GROUP BY 1, 2""")
def months_grid(spark: SparkSession, sf: str) -> DataFrame:
    """Transactions summed to months, the input of all windows: the sum of filled amounts (null without any), their count, and rows."""
    out = merge.monthly(orders(spark, sf), ["o_custkey"], "mon", {"amt": {"sum"}}, ["mon"])
    return rounded(out.select("o_custkey", F.col("__m").alias("mon"), F.col("amt__s").alias("total"), F.col("amt__n").alias("filled"), F.col("__rows").alias("n_rows")), "total", places=2)


@R.add(f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY md5('42|' || l_orderkey || '|' || l_linenumber)) - 1 AS r, count(*) OVER (PARTITION BY y) AS n FROM {ITEMS}),
s AS (SELECT * EXCLUDE (r, n, tr), CASE WHEN r < round_even(n * 0.2, 0) THEN 'test' WHEN r < round_even(n * 0.2, 0) + round_even(n * 0.15, 0) THEN 'val' ELSE 'train' END AS split FROM r),
m AS (SELECT median(disc) AS disc, median(tax) AS tax, list_distinct([round(x, 6) FOR x IN quantile_cont(l_extendedprice, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])]) AS cuts FROM s WHERE split = 'train'),
b AS (SELECT s.*, CAST(('0x' || substr(md5(l_orderkey || '|' || l_linenumber), 1, 8))::BIGINT % 5 AS INT) AS f FROM s),
c AS (SELECT l_returnflag AS k, f, count(*) AS n, sum(y) AS b FROM b WHERE split = 'train' GROUP BY 1, 2), a AS (SELECT k, sum(n) AS n, sum(b) AS b FROM c GROUP BY 1), t AS (SELECT f, sum(n) AS n, sum(b) AS b FROM c GROUP BY 1), z AS (SELECT sum(n) AS n, sum(b) AS b FROM c),
j AS (SELECT b.*, a.n - CASE WHEN split = 'train' THEN coalesce(c.n, 0) ELSE 0 END AS n, a.b - CASE WHEN split = 'train' THEN coalesce(c.b, 0) ELSE 0 END AS bad, z.n - CASE WHEN split = 'train' THEN t.n ELSE 0 END AS an, z.b - CASE WHEN split = 'train' THEN t.b ELSE 0 END AS ab
FROM b CROSS JOIN z LEFT JOIN a ON a.k = b.l_returnflag LEFT JOIN c ON c.k = b.l_returnflag AND c.f = b.f LEFT JOIN t ON t.f = b.f)
SELECT l_orderkey, l_linenumber, y, split, strftime(l_shipdate, '%Y-%m') AS shipped, coalesce(j.disc, m.disc) AS disc, coalesce(j.tax, m.tax) AS tax, CAST(len(list_filter(cuts, lambda x: x <= l_extendedprice)) + 1 AS INT) AS decile,
round(CASE WHEN coalesce(n, 0) > 0 THEN (bad + 20 * (ab / an)) / (n + 20) ELSE ab / an END, 6) AS rate, round(coalesce(j.disc, m.disc) / nullif(coalesce(j.tax, m.tax), 0), 6) AS ratio FROM j, m""")
def recipe_rebuild(spark: SparkSession, sf: str) -> DataFrame:
    """A recipe of nine steps is fitted, written, read and rebuilt from its base."""
    roles = columns.Roles(target="y", ident="l_orderkey")
    base, keys = items(spark, sf), ["l_orderkey", "l_linenumber"]
    steps = [
        recipe.Step("convert", {"changes": {"l_shipdate": "kategorik_ay"}}, "01"),
        recipe.Step("drop", {"columns": ["l_linestatus", "l_partkey", "tr", "y"]}, "01"),
        recipe.Step("split", {"method": "rows", "keys": keys, "strata": ["y"], "ratios": {split.TEST: 0.2, split.VAL: 0.15}}, "01"),
        recipe.Step("rename", {"names": {"l_shipdate": "shipped"}}, "02.1"),
        recipe.Step("fill", {"columns": ["disc", "tax"]}, "02.1"),
        recipe.Step("deciles", {"columns": ["l_extendedprice"]}, "02.2"),
        recipe.Step("encode", {"column": "l_returnflag", "target": "y", "keys": keys, "kinds": ["te"]}, "02.2"),
        recipe.Step("expressions", {"columns": {"ratio": "disc / tax"}}, "02.2"),
        recipe.Step("rename", {"names": {"l_extendedprice__DLM": "decile", "l_returnflag__TE": "rate", split.SPLIT: "split"}}, "03"),
    ]
    made, _ = recipe.fit(base, steps, roles)
    root = store.scratch(spark, "recipes")
    recipe.save(spark, made, root, "items")
    out = recipe.rebuild(recipe.load(spark, root, "items"), base)
    return rounded(out.select(*keys, "y", "split", "shipped", "disc", "tax", "decile", "rate", "ratio"), "rate", "ratio")


@R.add()
def model_importance(spark: SparkSession, sf: str) -> DataFrame:
    """Forest importances, columns and their null indicators together."""
    values = select.importance(items(spark, sf).where("tr"), ["l_quantity", "disc", "tax"], "y")
    return spark.createDataFrame([(c, float(round(v, 6))) for c, v in values.items()], "column string, importance double")


@R.add()
def model_comparison(spark: SparkSession, sf: str) -> DataFrame:
    """Boosted trees on a base and on an enlarged column set."""
    df = items(spark, sf)
    return select.compare(df.where("tr"), df.where("NOT tr"), ["disc", "tax"], ["l_quantity"], "y")


@R.add()
def text_topics(spark: SparkSession, sf: str) -> DataFrame:
    """The strongest topic of each document."""
    return remedies.topics(t(spark, sf, "documents"), "text", "doc_id")
