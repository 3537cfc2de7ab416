"""Queries of proposals and corrections, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.functions.exprs import spelling_key
from tabloom.operators import advice, binning, remedies
from tabloom.plans.base import ITEMS, Registry, items, rounded, t

R = Registry()

_NUMBERS = ("l_quantity", "l_extendedprice", "disc", "tax", "heavy")
_HEAVY = f"(SELECT *, exp(l_quantity / 5) AS heavy FROM {ITEMS})"


def _number_facts(c: str) -> str:
    return f"""SELECT '{c}' AS "column", 'evet' AS "use", CASE WHEN count({c}) < count(*) THEN 'medyan' ELSE 'yok' END AS missing,
CASE WHEN avg(CAST(v < q1 - 3 * (q3 - q1) OR v > q3 + 3 * (q3 - q1) AS INT)) > 0.005 THEN 'winsor' ELSE 'yok' END AS extreme,
CASE WHEN skewness(v) > 2 AND min(v) >= 0 THEN 'log' ELSE 'yok' END AS transform, 'yok' AS binning
FROM (SELECT *, CAST({c} AS DOUBLE) AS v FROM {_HEAVY}), (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM {_HEAVY})"""


@R.add(" UNION ALL ".join(map(_number_facts, _NUMBERS)))
def variable_decisions(spark: SparkSession, sf: str) -> DataFrame:
    """How numbers enter a model: medians for gaps, clips for outliers, logarithms for long tails."""
    df = items(spark, sf).withColumn("heavy", F.exp(F.col("l_quantity") / 5))
    counts = df.agg(*[F.struct(F.count_if(F.col(c).isNull()).alias("n"), F.min(c).cast("double").alias("m")).alias(c) for c in _NUMBERS])
    gaps = counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"{c}.n").alias("n_missing"), F.col(f"{c}.m").alias("least")) for c in _NUMBERS])).alias("x")).select("x.*")
    no = F.lit(False)
    facts = binning.variable_detail(df, _NUMBERS).join(gaps, "column").withColumns({"categorical": no, "missing_differs": no, "leak": no, "sensitive": no, "shape": F.lit(None).cast("string"), "bins": F.lit(1)})
    return advice.variable_decisions(facts)


_RULED = """SELECT p_partkey AS "column", p_size % 2 = 0 AS categorical, p_size % 3 = 0 AS leak, p_size % 5 = 0 AS sensitive, p_size % 4 AS bins, CASE p_size % 7 WHEN 0 THEN 'U' WHEN 1 THEN 'artan' END AS shape,
CASE WHEN p_size % 6 = 0 THEN 0 ELSE p_size END AS n_missing, p_size % 4 = 1 AS missing_differs, p_size / 1000.0 AS outlier_share, p_size / 10.0 AS skew, CAST(p_size - 30 AS DOUBLE) AS least FROM part"""


@R.add(f"""WITH f AS ({_RULED}), g AS (SELECT *, bins > 1 AND (categorical OR sensitive OR coalesce(shape = 'U', FALSE)) AS binned FROM f)
SELECT "column", CASE WHEN leak OR (sensitive AND bins <= 1) THEN 'hayir' ELSE 'evet' END AS "use", CASE WHEN n_missing = 0 THEN 'yok' WHEN categorical THEN 'missing' WHEN missing_differs THEN 'isaret' ELSE 'medyan' END AS missing,
CASE WHEN NOT categorical AND NOT binned AND outlier_share > 0.005 THEN 'winsor' ELSE 'yok' END AS extreme, CASE WHEN NOT categorical AND NOT binned AND skew > 2 AND least >= 0 THEN 'log' ELSE 'yok' END AS transform,
CASE WHEN binned THEN 'onerilen' ELSE 'yok' END AS binning FROM g""")
def variable_rules(spark: SparkSession, sf: str) -> DataFrame:
    """The rules over every combination of facts, with a part's row standing for a variable's."""
    s = F.col("p_size")
    facts = t(spark, sf, "part").select(
        F.col("p_partkey").alias("column"), (s % 2 == 0).alias("categorical"), (s % 3 == 0).alias("leak"), (s % 5 == 0).alias("sensitive"), (s % 4).alias("bins"), F.when(s % 7 == 0, "U").when(s % 7 == 1, "artan").alias("shape"),
        F.when(s % 6 == 0, 0).otherwise(s).alias("n_missing"), (s % 4 == 1).alias("missing_differs"), (s / 1000.0).alias("outlier_share"), (s / 10.0).alias("skew"), (s - 30).cast("double").alias("least"),
    )
    return advice.variable_decisions(facts)


@R.add("""WITH g AS (SELECT p_partkey AS "column", p_size % 2 = 0 AS categorical, CASE p_size % 3 WHEN 0 THEN 'evet' WHEN 1 THEN 'hayir' ELSE 'belki' END AS u, ['yok', 'medyan', 'sabit', 'isaret', 'missing', 'x'][p_size % 6 + 1] AS m,
CASE p_size % 4 WHEN 0 THEN '1,5' WHEN 1 THEN 'a' WHEN 2 THEN '2.25' END AS v, ['yok', 'winsor', 'y'][p_size % 3 + 1] AS e, ['log', 'ustel', 'sira', 'kare'][p_size % 4 + 1] AS f, ['onerilen', 'z'][p_size % 2 + 1] AS b FROM part),
h AS (SELECT *, CASE WHEN m = 'x' THEN 'yok' ELSE m END AS k, TRY_CAST(replace(v, ',', '.') AS DOUBLE) AS n FROM g)
SELECT "column", CASE u WHEN 'hayir' THEN 'hayir' ELSE 'evet' END AS "use", CASE WHEN categorical AND k IN ('medyan', 'sabit', 'isaret') THEN 'missing' WHEN NOT categorical AND k = 'missing' THEN 'isaret' WHEN k = 'sabit' AND n IS NULL THEN 'medyan' ELSE k END AS missing, n AS missing_value,
CASE WHEN categorical OR e = 'y' THEN 'yok' ELSE e END AS extreme, CASE WHEN categorical OR f = 'kare' THEN 'yok' ELSE f END AS transform, CASE b WHEN 'z' THEN 'yok' ELSE b END AS binning FROM h""")
def decisions_valid(spark: SparkSession, sf: str) -> DataFrame:
    """Decisions from outside, reduced to what can be carried out."""
    s, pick = F.col("p_size"), lambda n, *v: F.element_at(F.array(*map(F.lit, v)), (F.col("p_size") % n + 1).cast("int"))
    given = t(spark, sf, "part").select(
        F.col("p_partkey").alias("column"), (s % 2 == 0).alias("categorical"), pick(3, "evet", "hayir", "belki").alias("use"), pick(6, "yok", "medyan", "sabit", "isaret", "missing", "x").alias("missing"),
        F.when(s % 4 == 0, "1,5").when(s % 4 == 1, "a").when(s % 4 == 2, "2.25").alias("missing_value"), pick(3, "yok", "winsor", "y").alias("extreme"), pick(4, "log", "ustel", "sira", "kare").alias("transform"), pick(2, "onerilen", "z").alias("binning"),
    )
    return advice.valid_decisions(given)


_COLUMNS = {"o_orderkey": "tam", "o_custkey": "tam", "o_orderstatus": "metin", "o_totalprice": "ondalik", "o_orderdate": "tarih", "o_orderpriority": "metin", "flag": "tam", "same": "metin", "empty": "ondalik", "name": "metin"}
_WIDE = "(SELECT *, CAST(o_orderkey % 2 AS INT) AS flag, 'x' AS same, CAST(NULL AS DOUBLE) AS empty, 'n' || o_custkey AS name FROM orders)"


def _reason(c: str, kind: str) -> str:
    number = "TRUE" if kind in ("tam", "ondalik") else "FALSE"
    zero_one = f"min({c}) = 0 AND max({c}) = 1" if kind in ("tam", "ondalik") else "FALSE"
    fixed = "'rol'" if c == "o_orderkey" else "'haric'" if c == "o_custkey" else "'tarih'" if kind == "tarih" else "NULL"
    return f"""SELECT '{c}' AS "column", '{kind}' AS kind, coalesce({fixed}, CASE WHEN count(DISTINCT {c}) <= 1 THEN 'sabit' WHEN {number} AND count(DISTINCT {c}) = 2 AND {zero_one} THEN 'bayrak' WHEN NOT {number} AND count(DISTINCT {c}) > 200 THEN 'cok_degerli' END) AS reason FROM {_WIDE}"""


@R.add(" UNION ALL ".join(_reason(c, k) for c, k in _COLUMNS.items()))
def generation_columns(spark: SparkSession, sf: str) -> DataFrame:
    """Which columns of orders take part in generation, and why others don't."""
    df = t(spark, sf, "orders").withColumns({"flag": (F.col("o_orderkey") % 2).cast("int"), "same": F.lit("x"), "empty": F.lit(None).cast("double"), "name": F.concat(F.lit("n"), F.col("o_custkey"))})
    return advice.generation_columns(df, roles=["o_orderkey"], excluded=["o_custkey"])


def _flag(c: str) -> str:
    return f"""SELECT '{c}' AS "column", count({c}) AS filled, count(*) - count({c}) AS missing, avg(y) FILTER ({c} IS NOT NULL) AS filled_rate, avg(y) FILTER ({c} IS NULL) AS missing_rate, avg(y) AS p FROM {_GAPS} WHERE tr"""


_GAPS = f"(SELECT *, CASE WHEN y = 0 OR l_orderkey % 3 = 0 THEN l_partkey END AS told FROM {ITEMS})"


@R.add(f"""SELECT "column", filled, missing, round(filled_rate, 6) AS filled_rate, round(missing_rate, 6) AS missing_rate, CASE WHEN least(filled, missing) >= 30 AND p > 0 AND p < 1 AND abs(filled_rate - missing_rate) >= 2.58 * sqrt(p * (1 - p) * (1.0 / filled + 1.0 / missing)) THEN 'dolu_bayrak' ELSE 'cikar' END AS remedy
FROM ({" UNION ALL ".join(map(_flag, ("disc", "tax", "told", "l_quantity")))})""")
def remedies_filled_flags(spark: SparkSession, sf: str) -> DataFrame:
    """For which columns a filled flag says something about the target."""
    df = items(spark, sf).withColumn("told", F.when((F.col("y") == 0) | (F.col("l_orderkey") % 3 == 0), F.col("l_partkey")))
    return rounded(advice.filled_flags(df.where("tr"), ["disc", "tax", "told", "l_quantity"], "y"), "filled_rate", "missing_rate")


@R.add("""SELECT o_orderpriority AS priority, CASE WHEN o_orderkey % 5 > 1 THEN o_orderstatus END AS status, CASE WHEN o_totalprice >= 100000 THEN CAST(round_even(o_totalprice - 100000, 0) AS BIGINT) END AS price, count(*) AS n FROM orders GROUP BY 1, 2, 3""")
def remedies_corrections(spark: SparkSession, sf: str) -> DataFrame:
    """Spellings, texts that mean nothing, negatives and decimals, in the fixed order whatever order they are given in."""
    key, p = F.col("o_orderkey"), F.col("o_orderpriority")
    targets = {r.k: r.p for r in t(spark, sf, "orders").select(spelling_key("o_orderpriority").alias("k"), p.alias("p")).distinct().collect()}
    df = t(spark, sf, "orders").select(
        F.when(key % 3 == 0, F.upper(p)).when(key % 3 == 1, F.concat(F.lit("  "), F.lower(p))).otherwise(p).alias("priority"),
        F.when(key % 5 == 0, "Bilinmiyor").when(key % 5 == 1, " - ").otherwise(F.col("o_orderstatus")).alias("status"), (F.col("o_totalprice") - 100000).alias("price"),
    )
    steps = [("negative", "price", remedies.negative_to_null("price")), ("round", "price", remedies.rounded("price", 0)), ("spelling", "priority", remedies.canonical_spelling("priority", targets)), ("empty_text", "status", remedies.empty_text_to_null("status"))]
    for _, column, value in remedies.in_order(steps):
        df = df.withColumn(column, value)
    return df.groupBy("priority", "status", "price").agg(F.count(F.lit(1)).alias("n"))


_CODE = "(SELECT substr(o_orderpriority, 1, 1) || lpad(CAST(o_custkey % 50 AS VARCHAR), 3, '0') AS code FROM orders)"


@R.add(f"""SELECT substr(code, 1, k) AS start, count(*) AS n FROM {_CODE}, (SELECT max(k) AS k FROM (SELECT k, count(DISTINCT substr(code, 1, k)) AS d FROM {_CODE}, (SELECT unnest([1, 2, 3]) AS k) GROUP BY 1) WHERE d BETWEEN 2 AND 200) GROUP BY 1""")
def remedies_prefixes(spark: SparkSession, sf: str) -> DataFrame:
    """Codes by the longest prefix that makes 2 to 200 groups."""
    df = t(spark, sf, "orders").select(F.concat(F.substring("o_orderpriority", 1, 1), F.lpad((F.col("o_custkey") % 50).cast("string"), 3, "0")).alias("code"))
    return df.groupBy(F.substring("code", 1, remedies.prefix_length(df, "code")).alias("start")).agg(F.count(F.lit(1)).alias("n"))


@R.add("""SELECT c_custkey, CASE WHEN c_acctbal IS NULL THEN NULL WHEN c_acctbal / 10000 < 0.02 THEN 'önemsiz' WHEN c_acctbal / 10000 < 0.10 THEN 'zayıf' WHEN c_acctbal / 10000 < 0.30 THEN 'orta' ELSE 'güçlü' END AS band FROM customer""")
def binning_bands(spark: SparkSession, sf: str) -> DataFrame:
    """Names of information values, here of a share of each customer."""
    return t(spark, sf, "customer").select("c_custkey", binning.iv_band(F.col("c_acctbal") / 10000).alias("band"))
