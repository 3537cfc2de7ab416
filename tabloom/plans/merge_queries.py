"""Merging, stacking, splitting and conversion queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.functions import periods
from tabloom.operators import convert, merge, split
from tabloom.operators.merge import Aggregate, Plan, Source
from tabloom.plans.base import ITEMS, MONTH, OBS, ORDERS, Registry, items, observations, orders, rounded, t
from tabloom.sources import tables

R = Registry()


def _window_sql(aggregates: list[tuple[str, Aggregate]], obs: str = OBS) -> str:
    """The same windows as a range join with conditional aggregates."""
    cols = []
    for name, a in aggregates:
        n = merge.WINDOWS[a.window]
        w = "t.mon < o.mon" + (f" AND t.mon >= o.mon - {n}" if n else "")
        rows = f"count(*) FILTER (t.o_custkey IS NOT NULL AND {w})"
        x = f"t.{a.column}"
        cols.append({
            "count": f"nullif({rows}, 0)",
            "sum": f"round(CASE WHEN {rows} > 0 THEN coalesce(sum({x}) FILTER ({w}), 0) END, 2)",
            "mean": f"round(avg({x}) FILTER ({w}), 4)",
            "max": f"max({x}) FILTER ({w})", "min": f"min({x}) FILTER ({w})",
            "std": f"round(CASE WHEN count({x}) FILTER ({w}) > 1 THEN stddev_samp({x}) FILTER ({w}) END, 4)",
            "nunique": f"CASE WHEN {rows} > 0 THEN count(DISTINCT {x}) FILTER ({w}) END",
            "last": f"(arg_max({{'v': {x}}}, (t.mon, t.o_orderkey)) FILTER ({w})).v",
        }[a.function] + f" AS {name}")
    return f"SELECT o.o_custkey, o.mon, {', '.join(cols)} FROM {obs} o LEFT JOIN {ORDERS} t ON t.o_custkey = o.o_custkey AND t.mon < o.mon GROUP BY 1, 2"


def _windows(spark: SparkSession, sf: str, aggregates: list[tuple[str, Aggregate]]) -> DataFrame:
    out = merge.pit_aggregate(observations(spark, sf), orders(spark, sf), ["o_custkey"], "mon", "mon", aggregates, ["mon", "o_orderkey"])
    for name, a in aggregates:
        if a.function in ("sum", "mean", "std"):
            out = out.withColumn(name, F.round(name, 2 if a.function == "sum" else 4))
    return out


_SLICE = [("sum_3", Aggregate("sum", "son_3a", "amt")), ("mean_3", Aggregate("mean", "son_3a", "amt")), ("sum_12", Aggregate("sum", "son_12a", "amt")), ("mean_12", Aggregate("mean", "son_12a", "amt"))]


@R.add(f"SELECT *, round(CASE WHEN sum_12 <> 0 THEN sum_3 / sum_12 END, 6) AS share_3_12 FROM ({_window_sql(_SLICE)})")
def flagship_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Total and mean order value of the previous 3 and 12 months, and their ratio."""
    out = _windows(spark, sf, _SLICE)
    return out.withColumn("share_3_12", F.round(F.try_divide("sum_3", F.nullif("sum_12", F.lit(0.0))), 6))


def _register_windows() -> None:
    for function in merge.FUNCTIONS:
        aggs = [(f"{function}_{w}", Aggregate(function, w, None if function == "count" else "amt" if function != "nunique" else "o_orderpriority")) for w in ("son_1a", "son_3a", "son_12a", "tum")]

        def query(spark: SparkSession, sf: str, aggs: list = aggs) -> DataFrame:
            return _windows(spark, sf, aggs)

        query.__name__ = f"pit_{function}"
        R.add(_window_sql(aggs))(query)


_register_windows()


@R.add(f"""WITH v AS (SELECT o_custkey, mon, arg_max(o_orderpriority, o_orderkey) AS prio, arg_max(o_orderkey, o_orderkey) AS ord FROM {ORDERS} GROUP BY 1, 2),
o AS (SELECT o_custkey, mon + 1 AS obs FROM {OBS})
SELECT o.o_custkey, o.obs, v.prio, v.ord FROM o ASOF LEFT JOIN v ON o.o_custkey = v.o_custkey AND v.mon <= o.obs""")
def join_asof(spark: SparkSession, sf: str) -> DataFrame:
    dim = orders(spark, sf).select("o_custkey", "mon", F.col("o_orderpriority").alias("prio"), F.col("o_orderkey").alias("ord"))
    main = observations(spark, sf).select("o_custkey", (F.col("mon") + 1).alias("obs"))
    return merge.asof_join(main, dim, ["o_custkey"], "obs", "mon", ["prio", "ord"], ["ord"])


@R.add("""SELECT o.o_orderkey, d.c_mktsegment, d.c_acctbal FROM (SELECT *, CASE WHEN o_orderkey % 5 <> 0 THEN o_custkey END AS k FROM orders) o
LEFT JOIN (SELECT k, arg_min(c_mktsegment, c_custkey) AS c_mktsegment, arg_min(c_acctbal, c_custkey) AS c_acctbal FROM (SELECT *, CASE WHEN c_custkey % 9 <> 0 THEN c_custkey - c_custkey % 3 END AS k FROM customer) GROUP BY k) d
ON o.k IS NOT DISTINCT FROM d.k""")
def join_first(spark: SparkSession, sf: str) -> DataFrame:
    """A dimension without time: the first row of each key; null keys meet."""
    dim = t(spark, sf, "customer").withColumn("k", F.when(F.col("c_custkey") % 9 != 0, F.col("c_custkey") - F.col("c_custkey") % 3))
    main = t(spark, sf, "orders").withColumn("k", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_custkey")))
    return merge.first_join(main, dim, ["k"], ["c_mktsegment", "c_acctbal"], ["c_custkey"]).select("o_orderkey", "c_mktsegment", "c_acctbal")


@R.add(f"""SELECT c.c_custkey, a.n_all, round(a.s_all, 2) AS s_all, a.kinds FROM customer c LEFT JOIN
(SELECT o_custkey, count(*) AS n_all, coalesce(sum(amt), 0) AS s_all, count(DISTINCT o_orderpriority) AS kinds FROM {ORDERS} GROUP BY 1) a ON a.o_custkey = c.c_custkey""")
def join_total(spark: SparkSession, sf: str) -> DataFrame:
    aggs = [("n_all", Aggregate("count", "tum")), ("s_all", Aggregate("sum", "tum", "amt")), ("kinds", Aggregate("nunique", "tum", "o_orderpriority"))]
    out = merge.total_aggregate(t(spark, sf, "customer").withColumnRenamed("c_custkey", "o_custkey"), orders(spark, sf), ["o_custkey"], aggs)
    return rounded(out.select(F.col("o_custkey").alias("c_custkey"), "n_all", "s_all", "kinds"), "s_all", places=2)


def _plan() -> Plan:
    return Plan("obs", [
        Source("orders", "islem", ["o_custkey"], "ym", aggregates=[Aggregate("sum", "son_3a", "amt"), Aggregate("count", "tum"), Aggregate("median", "tum", "amt")]),
        Source("customer", "boyut", ["o_custkey"], columns=["c_mktsegment"]),
        Source("nowhere", "boyut", ["o_custkey"], columns=["x"]),
    ], "ym")


def _plan_tables(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    ym = periods.month_text(F.col("mon"))
    return {
        "obs": observations(spark, sf).withColumn("ym", ym).drop("mon"),
        "orders": orders(spark, sf).select("o_custkey", "amt", F.date_format("o_orderdate", "yyyyMMdd").alias("ym")),
        "customer": t(spark, sf, "customer").withColumnRenamed("c_custkey", "o_custkey"),
    }


@R.add(f"""SELECT o.o_custkey, printf('%04d%02d', CAST((o.mon - 1) // 12 AS INT), CAST(o.mon - 12 * ((o.mon - 1) // 12) AS INT)) AS ym,
round(CASE WHEN count(*) FILTER (t.o_custkey IS NOT NULL AND t.mon >= o.mon - 3) > 0 THEN coalesce(sum(t.amt) FILTER (t.mon >= o.mon - 3), 0) END, 2) AS orders__amt_SUM_3A,
nullif(count(t.o_custkey), 0) AS orders__KAYIT_COUNT_TUM, any_value(c.c_mktsegment) AS c_mktsegment
FROM {OBS} o LEFT JOIN {ORDERS} t ON t.o_custkey = o.o_custkey AND t.mon < o.mon LEFT JOIN customer c ON c.c_custkey = o.o_custkey GROUP BY o.o_custkey, o.mon""")
def merge_plan(spark: SparkSession, sf: str) -> DataFrame:
    """A validated plan: what can't run is dropped with a note, the rest is executed source by source."""
    read = _plan_tables(spark, sf)
    plan, _ = merge.validate(_plan(), {k: v.columns for k, v in read.items()})
    out, _, _ = merge.execute(plan, read.__getitem__)
    return rounded(out, "orders__amt_SUM_3A", places=2)


@R.add("""SELECT * FROM (VALUES ('o_custkey', 'obs', NULL, NULL, NULL, TRUE), ('ym', 'obs', NULL, NULL, NULL, TRUE),
('orders__amt_SUM_3A', 'orders', 'o_custkey', 'sum', 'son_3a', TRUE), ('orders__KAYIT_COUNT_TUM', 'orders', 'o_custkey', 'count', 'tum', TRUE),
('c_mktsegment', 'customer', 'o_custkey', 'first', NULL, FALSE)) v(KOLON, KAYNAK_TABLO, ANAHTAR, FONKSIYON, PENCERE, POINT_IN_TIME)""")
def merge_lineage(spark: SparkSession, sf: str) -> DataFrame:
    read = _plan_tables(spark, sf)
    plan, _ = merge.validate(_plan(), {k: v.columns for k, v in read.items()})
    return spark.createDataFrame(merge.execute(plan, read.__getitem__)[1], merge.LINEAGE).drop("NOTU")


@R.add("SELECT year(o_orderdate) AS yr, count(*) AS n, round(sum(o_totalprice), 2) AS total, sum(o_custkey) AS keys FROM orders GROUP BY 1")
def union_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Tables with one set of columns, in any order, stacked by name."""
    o = t(spark, sf, "orders")
    parts = [o.where(F.year("o_orderdate") % 2 == 0), o.where(F.year("o_orderdate") % 2 == 1).select(*reversed(o.columns)).withColumn("o_custkey", F.col("o_custkey").cast("int"))]
    return merge.union_all(parts).groupBy(F.year("o_orderdate").alias("yr")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.sum("o_custkey").alias("keys"))


@R.add("""WITH e AS (SELECT user_id, event_type, CAST(floor(value) AS INT) % 3 AS v FROM events)
SELECT (SELECT count(*) FROM e) - (SELECT count(*) FROM (SELECT DISTINCT * FROM e)) AS full_rows,
(SELECT count(*) FROM e) - (SELECT count(*) FROM (SELECT DISTINCT user_id, event_type FROM e)) AS key_rows,
(SELECT count(*) FROM e) - (SELECT count(*) FROM (SELECT DISTINCT user_id, event_type FROM e)) AS any_rows""")
def duplicate_rows(spark: SparkSession, sf: str) -> DataFrame:
    e = t(spark, sf, "events").select("user_id", "event_type", (F.floor("value").cast("int") % 3).alias("v"))
    return merge.duplicates(e, "user_id", "event_type")


# ---- conversions ------------------------------------------------------------------------------

@R.add("""SELECT 'txt' AS "column", 'sayisal_nokta' AS code, count(*) AS filled, count(*) FILTER (l_orderkey % 50 = 0) AS failed FROM lineitem
UNION ALL SELECT 'd', 'tarih_ymd', count(*), 0 FROM lineitem""")
def conversion_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Failures are counted over the whole column before anything is converted."""
    li = t(spark, sf, "lineitem")
    txt = F.when(F.col("l_orderkey") % 50 == 0, F.lit("12,34")).otherwise(F.format_number("l_extendedprice", 2))
    df = li.select(txt.alias("txt"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("d"))
    return convert.audit(df, [("txt", "sayisal_nokta"), ("d", "tarih_ymd")]).drop("examples")


@R.add("SELECT l_orderkey, l_linenumber, round(l_extendedprice, 2) AS price, CAST(l_shipdate AS DATE) AS shipped FROM lineitem")
def conversion_apply(spark: SparkSession, sf: str) -> DataFrame:
    li = t(spark, sf, "lineitem")
    df = li.select("l_orderkey", "l_linenumber", F.format_number("l_extendedprice", 2).alias("price"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("shipped"))
    out, _ = convert.apply(df, [("price", "sayisal_nokta"), ("shipped", "tarih_ymd")])
    return out.select("l_orderkey", "l_linenumber", F.round("price", 2).alias("price"), F.col("shipped").cast("date").alias("shipped"))


# ---- splits ------------------------------------------------------------------------------------


@R.add(f"""WITH r AS (SELECT l_orderkey, l_linenumber, y, row_number() OVER (PARTITION BY y ORDER BY md5('42|' || l_orderkey || '|' || l_linenumber)) - 1 AS r, count(*) OVER (PARTITION BY y) AS n FROM {ITEMS}),
s AS (SELECT *, CAST(round_even(n * 0.2, 0) AS BIGINT) AS a, CAST(round_even(n * 0.15, 0) AS BIGINT) AS b FROM r)
SELECT l_orderkey, l_linenumber, y, CASE WHEN r < a THEN 'test' WHEN r < a + b THEN 'val' ELSE 'train' END AS split FROM s""")
def split_rows(spark: SparkSession, sf: str) -> DataFrame:
    out = split.stratified(items(spark, sf), ["l_orderkey", "l_linenumber"], ["y"], [("test", 0.2), ("val", 0.15)])
    return out.select("l_orderkey", "l_linenumber", "y", F.col(split.SPLIT).alias("split"))


@R.add(f"""WITH ids AS (SELECT l_partkey, max(y) AS y, min(l_returnflag) AS seg FROM {ITEMS} GROUP BY 1),
r AS (SELECT *, row_number() OVER (PARTITION BY y, seg ORDER BY md5('42|' || l_partkey)) - 1 AS r, count(*) OVER (PARTITION BY y, seg) AS n FROM ids),
w AS (SELECT *, CASE WHEN n >= 3 AND round_even(n * 0.2, 0) < 1 THEN 1 ELSE CAST(round_even(n * 0.2, 0) AS BIGINT) END AS wa FROM r),
a AS (SELECT *, greatest(least(wa, n - 1), 0) AS a FROM w), b AS (SELECT *, greatest(least(wa, n - 1 - a), 0) AS b FROM a),
l AS (SELECT l_partkey, CASE WHEN r < a THEN 'test' WHEN r < a + b THEN 'val' ELSE 'train' END AS split FROM b)
SELECT l.split, count(*) AS n_rows, count(DISTINCT i.l_partkey) AS ids, sum(i.y) AS positives FROM {ITEMS} i JOIN l USING (l_partkey) GROUP BY 1""")
def split_ids(spark: SparkSession, sf: str) -> DataFrame:
    """All rows of an id share a set."""
    out = split.stratified_by_id(items(spark, sf), "l_partkey", "y", [("test", 0.2), ("val", 0.2)], "l_returnflag")
    return out.groupBy(F.col(split.SPLIT).alias("split")).agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("l_partkey").alias("ids"), F.sum("y").alias("positives"))


@R.add("""WITH p AS (SELECT strftime(o_orderdate, '%Y') AS p, count(*) AS n FROM orders GROUP BY 1),
pool AS (SELECT *, sum(n) OVER (ORDER BY p DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS later, sum(n) OVER () AS total, row_number() OVER (ORDER BY p) AS i FROM p WHERE p < '1999')
SELECT o.p, CASE WHEN o.p IN ('2000', '2001') THEN 'test' WHEN o.p = '1999' THEN 'disarida' WHEN q.i > 1 AND coalesce(q.later, 0) < 0.3 * q.total THEN 'val' ELSE 'train' END AS split, o.n
FROM p o LEFT JOIN pool q ON q.p = o.p""")
def split_temporal(spark: SparkSession, sf: str) -> DataFrame:
    df = t(spark, sf, "orders").select(F.date_format("o_orderdate", "yyyy").alias("p"))
    out = split.temporal(df, "p", ["2000", "2001"], gap=1, val_ratio=0.3)
    return out.groupBy("p", F.col(split.SPLIT).alias("split")).agg(F.count(F.lit(1)).alias("n"))


@R.add("""SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'test' WHEN o_orderkey % 7 = 0 THEN 'val' WHEN o_orderkey % 3 = 0 THEN 'train' ELSE 'disarida' END AS by_flags,
CASE WHEN o_orderkey % 4 = 0 THEN 'train' WHEN o_orderkey % 4 = 1 THEN 'test' WHEN o_orderkey % 4 = 2 THEN 'oot' ELSE 'disarida' END AS by_label FROM orders""")
def split_ready(spark: SparkSession, sf: str) -> DataFrame:
    """Ready-made splits: 0/1 flags with a priority, and spelled labels."""
    k = F.col("o_orderkey")
    df = t(spark, sf, "orders").select("o_orderkey", (k % 3 == 0).cast("int").alias("M_TRAIN"), (k % 5 == 0).cast("int").alias("M_TEST"), (k % 7 == 0).cast("int").alias("M_VAL"), F.element_at(F.array(F.lit(" TRAIN"), F.lit("Test "), F.lit("oot"), F.lit("?")), (k % 4 + 1).cast("int")).alias("lab"))
    flagged = split.by_flags(df, {"train": "M_TRAIN", "test": "M_TEST", "val": "M_VAL"}).withColumnRenamed(split.SPLIT, "by_flags")
    found = split.find_ready({"lab": [" TRAIN", "Test ", "oot"]})
    return split.by_label(flagged, "lab", found[1]).select("o_orderkey", "by_flags", F.col(split.SPLIT).alias("by_label"))


@R.add(f"""WITH s AS (SELECT l_returnflag, y, CASE WHEN l_orderkey % 10 < 7 THEN 'train' ELSE 'test' END AS _SPLIT FROM {ITEMS})
SELECT l_returnflag, _SPLIT AS split, count(*) AS n_rows, sum(y) AS positives FROM s GROUP BY 1, 2""")
def split_summary(spark: SparkSession, sf: str) -> DataFrame:
    df = items(spark, sf).withColumn(split.SPLIT, F.when(F.col("tr"), "train").otherwise("test"))
    return split.summary(df, "y", "l_returnflag").withColumnRenamed(split.SPLIT, "split")


@R.add(f"SELECT l_orderkey, l_linenumber, CAST((row_number() OVER (PARTITION BY y ORDER BY md5('42|' || l_orderkey || '|' || l_linenumber)) - 1) % 5 AS INT) AS fold FROM {ITEMS}")
def folds_stratified(spark: SparkSession, sf: str) -> DataFrame:
    return split.folds(items(spark, sf), ["l_orderkey", "l_linenumber"], ["y"], 5).select("l_orderkey", "l_linenumber", "fold")


@R.add(f"""WITH g AS (SELECT l_orderkey, max(y) AS y FROM {ITEMS} GROUP BY 1),
f AS (SELECT l_orderkey, CAST((row_number() OVER (PARTITION BY y ORDER BY md5('42|' || l_orderkey)) - 1) % 4 AS INT) AS fold FROM g)
SELECT fold, count(*) AS n_rows, count(DISTINCT l_orderkey) AS groups FROM {ITEMS} JOIN f USING (l_orderkey) GROUP BY 1""")
def folds_grouped(spark: SparkSession, sf: str) -> DataFrame:
    out = split.folds(items(spark, sf), ["l_orderkey", "l_linenumber"], ["y"], 4, group="l_orderkey")
    return out.groupBy("fold").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("l_orderkey").alias("groups"))


@R.add("""WITH p AS (SELECT year(o_orderdate) AS p, count(*) AS n, row_number() OVER (ORDER BY year(o_orderdate)) AS i, count(*) OVER () AS k FROM orders GROUP BY 1)
SELECT CAST(v.i - (v.k - 2) AS INT) AS fold, CASE WHEN p.i = v.i THEN 'valid' ELSE 'train' END AS part, CAST(sum(p.n) AS BIGINT) AS n_rows FROM p v JOIN p ON p.i <= v.i WHERE v.i > v.k - 3 AND v.i >= 2 GROUP BY 1, 2""")
def folds_walk_forward(spark: SparkSession, sf: str) -> DataFrame:
    return split.walk_forward(t(spark, sf, "orders").withColumn("p", F.year("o_orderdate")), "p", 3)


@R.add(f"""WITH s AS (SELECT l_partkey, l_returnflag, CAST(l_quantity AS INT) % 3 AS q, CASE WHEN tr THEN 'train' WHEN l_orderkey % 10 < 9 THEN 'test' ELSE 'val' END AS s FROM {ITEMS}), tr AS (SELECT * FROM s WHERE s = 'train')
SELECT s AS "set", 'kimlik' AS kind, count(DISTINCT l_partkey) AS ids, count(*) AS n_rows FROM s WHERE s <> 'train' AND l_partkey IN (SELECT l_partkey FROM tr) GROUP BY 1
UNION ALL SELECT s, 'anahtar', count(DISTINCT l_partkey), count(*) FROM s WHERE s <> 'train' AND (l_partkey, l_returnflag) IN (SELECT (l_partkey, l_returnflag) FROM tr) GROUP BY 1
UNION ALL SELECT s, 'tam', 0, count(*) FROM s WHERE s <> 'train' AND (l_partkey, l_returnflag, q) IN (SELECT (l_partkey, l_returnflag, q) FROM tr) GROUP BY 1""")
def split_overlap(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("l_orderkey") % 10
    df = items(spark, sf).select("l_partkey", "l_returnflag", (F.col("l_quantity").cast("int") % 3).alias("q"), F.when(F.col("tr"), "train").when(k < 9, "test").otherwise("val").alias(split.SPLIT))
    return split.overlap(df, "l_partkey", "l_returnflag")


@R.add(f"""WITH s AS (SELECT l_returnflag, l_linestatus, y, CASE WHEN tr THEN 'train' ELSE 'test' END AS s, l_returnflag || l_linestatus || (l_partkey % 400) AS seg FROM {ITEMS}),
c AS (SELECT a.seg, b.s, count(x.seg) AS n_rows, coalesce(sum(x.y), 0) AS positives FROM (SELECT DISTINCT seg FROM s) a CROSS JOIN (SELECT DISTINCT s FROM s) b LEFT JOIN s x ON x.seg = a.seg AND x.s = b.s GROUP BY 1, 2)
SELECT seg, s AS split, n_rows, CAST(positives AS BIGINT) AS positives FROM c WHERE n_rows < 50 OR positives < 20""")
def small_segments(spark: SparkSession, sf: str) -> DataFrame:
    df = items(spark, sf).withColumn(split.SPLIT, F.when(F.col("tr"), "train").otherwise("test")).withColumn("seg", F.concat("l_returnflag", "l_linestatus", (F.col("l_partkey") % 400).cast("string")))
    return split.small_segments(df, "y", "seg").withColumnRenamed(split.SPLIT, "split")


# ---- scans -------------------------------------------------------------------------------------


@R.add("""WITH r AS (SELECT o_orderkey, strftime(o_orderdate, '%Y%m') AS p, row_number() OVER (PARTITION BY strftime(o_orderdate, '%Y%m') ORDER BY o_orderkey) AS r, count(*) OVER (PARTITION BY strftime(o_orderdate, '%Y%m')) AS period_rows FROM orders)
SELECT o_orderkey, p, period_rows FROM r WHERE r <= 10""")
def preview_periods(spark: SparkSession, sf: str) -> DataFrame:
    df = t(spark, sf, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyyMM").alias("p"))
    return tables.preview(df, ["o_orderkey"], "p")


@R.add("SELECT 'orders' AS \"table\", 6 AS n_columns, 'ok' AS state UNION ALL SELECT 'nowhere', 0, 'absent'")
def table_listing(spark: SparkSession, sf: str) -> DataFrame:
    listed = tables.listing(spark, {"orders": f"{sf}/orders.parquet"})
    rows = listed.groupBy("table").agg(F.count(F.lit(1)).cast("int").alias("n_columns")).withColumn("state", F.lit(tables.readable(spark, sf, "orders")))
    return rows.unionAll(spark.createDataFrame([("nowhere", 0, tables.readable(spark, sf, "nowhere"))], "t string, n int, s string"))


__all__ = ["MONTH", "R"]
