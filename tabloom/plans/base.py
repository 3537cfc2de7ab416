"""What the query modules share: table access, derived inputs, registration."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Queries and their SQL twins by name."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None = None) -> Callable[[Query], Query]:
        def register(query: Query) -> Query:
            self.queries[query.__name__] = query
            if sql is not None:
                self.sql[query.__name__] = sql
            return query

        return register


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def month_of(c: str) -> Column:
    return F.year(c) * 12 + F.month(c)


MONTH = "(year(o_orderdate) * 12 + month(o_orderdate))"


def orders(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as transactions: a month index, and an amount that is null for every seventh order."""
    return t(spark, sf, "orders").select("*", month_of("o_orderdate").alias("mon"), F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice")).alias("amt"))


ORDERS = f"(SELECT *, {MONTH} AS mon, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS amt FROM orders)"


def observations(spark: SparkSession, sf: str) -> DataFrame:
    """One row for each customer and month with an order, over all months of the table."""
    return orders(spark, sf).select("o_custkey", "mon").distinct()


OBS = f"(SELECT DISTINCT o_custkey, mon FROM {ORDERS})"


def items(spark: SparkSession, sf: str) -> DataFrame:
    """Line items with derived nulls, a target and a train flag."""
    return t(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_returnflag", "l_linestatus", "l_shipdate",
        F.nullif("l_discount", F.lit(0.0)).alias("disc"), F.nullif("l_tax", F.lit(0.0)).alias("tax"),
        (F.col("l_quantity") * 100 + F.col("l_linenumber") * 37 + F.col("l_orderkey") % 1000 > 3200).cast("int").alias("y"),
        (F.col("l_orderkey") % 10 < 7).alias("tr"),
    )


ITEMS = """(SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_returnflag, l_linestatus, l_shipdate,
 nullif(l_discount, 0) AS disc, nullif(l_tax, 0) AS tax,
 CAST(l_quantity * 100 + l_linenumber * 37 + l_orderkey % 1000 > 3200 AS INT) AS y, l_orderkey % 10 < 7 AS tr FROM lineitem)"""


def family_table(spark: SparkSession, sf: str) -> DataFrame:
    """A window family by customer: amounts of the last 30, 90, 180 and 360 days before 2000, and its counts."""
    age = F.datediff(F.lit("2000-01-01").cast("date"), F.col("o_orderdate").cast("date"))
    aggs = []
    for d in (30, 90, 180, 360):
        inside = (age > 0) & (age <= d)
        aggs += [F.sum(F.when(inside, F.col("o_totalprice"))).alias(f"TXN_AMT_L{d}D"), F.count_if(inside).alias(f"TXN_CNT_L{d}D")]
    return t(spark, sf, "orders").groupBy("o_custkey").agg(*aggs)


FAMILY = "(SELECT o_custkey, " + ", ".join(
    f"sum(CASE WHEN age > 0 AND age <= {d} THEN o_totalprice END) AS TXN_AMT_L{d}D, count(*) FILTER (age > 0 AND age <= {d}) AS TXN_CNT_L{d}D" for d in (30, 90, 180, 360)
) + " FROM (SELECT *, date_diff('day', CAST(o_orderdate AS DATE), DATE '2000-01-01') AS age FROM orders) GROUP BY 1)"


def rounded(df: DataFrame, *names: str, places: int = 6) -> DataFrame:
    """Doubles rounded for comparison between engines."""
    return df.withColumns({n: F.round(F.col(n), places) for n in names})
