"""Feature, encoding, binning, remedy, text, selection and dictionary queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabloom.functions import language
from tabloom.operators import binning, features, gram, measures, neighbours, remedies, select, single, uplift, variables
from tabloom.plans.base import FAMILY, ITEMS, Registry, family_table, items, rounded, t
from tabloom.sources.store import materialise

R = Registry()
_AMT = [(f"TXN_AMT_L{d}D", d) for d in (30, 90, 180, 360)]


def _div(a: str, b: str) -> str:
    return f"CASE WHEN ({b}) <> 0 THEN ({a}) / ({b}) END"


def _family_sql() -> str:
    names, days = [c for c, _ in _AMT], [float(d) for _, d in _AMT]
    out: dict[str, str] = {}
    for i in range(3):
        a, c, ga, gc = names[i], names[i + 1], days[i], days[i + 1]
        prev = f"(({c} - {a}) * {ga} / {gc - ga})"
        out[f"{a}__DIV__{c}"] = _div(a, c)
        out[f"{a}__MINUS__{c}"] = f"{a} - {c}"
        out[f"{a}__NDIV__{c}"] = _div(f"{a} / {ga}", f"{c} / {gc}")
        out[f"{a}__GRW__{c}"] = _div(f"{a} - {prev}", f"abs({prev})")
    for i in range(4):
        for j in range(i + 2, 4):
            out[f"{names[i]}__DIV__{names[j]}"] = _div(names[i], names[j])
            out[f"{names[i]}__MINUS__{names[j]}"] = f"{names[i]} - {names[j]}"
    spans = [(0, 30), (30, 90), (90, 180), (180, 360)]
    slices = [names[0], *(f"({names[i + 1]} - {names[i]})" for i in range(3))]
    rates = [f"({s} / {float(b - a)})" for s, (a, b) in zip(slices, spans, strict=True)]
    full = " AND ".join(f"{n} IS NOT NULL" for n in names)
    for i in range(1, 4):
        mark = f"{spans[i][0]}_{spans[i][1]}"
        out[f"TXN_AMT__DNM_{mark}"] = slices[i]
        out[f"TXN_AMT__DPAY_{mark}"] = _div(slices[i], names[3])
    for i in range(3):
        out[f"TXN_AMT__DORAN_{spans[i][0]}_{spans[i][1]}"] = _div(rates[i], rates[i + 1])
    out["TXN_AMT__ARDISIK"] = f"CASE WHEN {full} THEN " + " + ".join(f"CAST({rates[i]} > {rates[i + 1]} AS DOUBLE)" for i in range(3)) + " END"
    out["TXN_AMT__ENYOGUN"] = _div(f"greatest({', '.join(slices)})", names[3])
    pairs = ", ".join(f"{{'x': ln({d}), 'y': {n} / {d}}}" for n, d in zip(names, days, strict=True))
    out["TXN_AMT__EGIM"] = f"CASE WHEN {full} THEN (SELECT regr_slope(p.y, p.x) FROM (SELECT unnest([{pairs}]) AS p)) END"
    rate_list = ", ".join(f"{n} / {d}" for n, d in zip(names, days, strict=True))
    out["TXN_AMT__DK"] = f"CASE WHEN {full} THEN list_stddev_pop([{rate_list}]) / nullif(abs(list_avg([{rate_list}])), 0) END"
    return "SELECT o_custkey, " + ", ".join(f"round({v}, 6) AS \"{k}\"" for k, v in out.items()) + f" FROM {FAMILY}"


@R.add(_family_sql())
def features_family(spark: SparkSession, sf: str) -> DataFrame:
    """Every feature of a window family, found by its column names."""
    f = family_table(spark, sf)
    stem, members = next((s, m) for s, m in features.families(f.columns).items() if s == "TXN_AMT")
    made = features.family(stem, members, ("oran", "fark", "norm", "buyume", "oran_tum", "fark_tum", "donem", "donem_pay", "donem_oran", "ardisik", "en_yogun", "egim", "dk"))
    out = features.add(f, made).select("o_custkey", *[f"`{n}`" for n in made])
    return rounded(out, *made)


@R.add(f"""SELECT l_orderkey, l_linenumber, l_quantity * l_quantity AS l_quantity__KARE, sign(l_quantity - 25) AS d__ISR, CAST(l_quantity = 25 AS DOUBLE) AS d0,
CAST(l_quantity >= 10 AS DOUBLE) AS l_quantity__GE_10, CAST(l_quantity <= 10 AS DOUBLE) AS l_quantity__LE_10, CAST(1 + CAST(l_quantity >= 10 AS INT) + CAST(l_quantity >= 30 AS INT) AS DOUBLE) AS l_quantity__KOVA FROM {ITEMS}""")
def features_single(spark: SparkSession, sf: str) -> DataFrame:
    df = items(spark, sf).withColumn("d", F.col("l_quantity") - 25)
    made = features.single("l_quantity", ("kare", "esik", "kova"), 10, (10.0, 30.0)) | features.single("d", ("isaret", "sifir"))
    return features.add(df, made).select("l_orderkey", "l_linenumber", *[n for n in made if n != "d__SIFIR"], F.col("d__SIFIR").alias("d0"))


@R.add(f"""SELECT o_custkey, round(TXN_AMT_L30D - TXN_AMT_L90D, 4) AS net, round({_div('TXN_AMT_L90D', 'TXN_CNT_L90D')}, 4) AS ort, round(TXN_CNT_L30D * TXN_CNT_L90D, 4) AS carpim,
CAST(CAST(TXN_AMT_L30D IS NULL AS INT) + CAST(TXN_AMT_L90D IS NULL AS INT) AS DOUBLE) AS eksik FROM {FAMILY}""")
def features_pairs(spark: SparkSession, sf: str) -> DataFrame:
    f = family_table(spark, sf)
    amount, count = next((a, c) for kind, a, c in features.pairs(f.columns) if kind == "ort" and a == "TXN_AMT_L90D")
    net, ort, carpim = features.pair("net", "TXN_AMT_L30D", "TXN_AMT_L90D"), features.pair("ort", amount, count), features.pair("carpim", "TXN_CNT_L30D", "TXN_CNT_L90D")
    made = {"net": next(iter(net.values())), "ort": next(iter(ort.values())), "carpim": next(iter(carpim.values())), "eksik": features.row_missing(["TXN_AMT_L30D", "TXN_AMT_L90D"])["SATIR_EKSIK_SAYISI"]}
    return rounded(features.add(f, made).select("o_custkey", *made), "net", "ort", "carpim", places=4)


@R.add("""WITH p AS (SELECT o_custkey, sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) AS A_TUTAR, sum(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END) AS B_TUTAR, sum(CASE WHEN o_orderstatus = 'P' THEN -o_totalprice END) AS C_TUTAR FROM orders GROUP BY 1),
c AS (SELECT o_custkey, greatest(A_TUTAR, 0) AS a, greatest(B_TUTAR, 0) AS b, greatest(C_TUTAR, 0) AS c FROM p), s AS (SELECT *, coalesce(a, 0) + coalesce(b, 0) + coalesce(c, 0) AS t FROM c)
SELECT o_custkey, round(CASE WHEN t > 0 THEN (coalesce(a, 0) ** 2 + coalesce(b, 0) ** 2 + coalesce(c, 0) ** 2) / t ** 2 END, 6) AS hhi, round(CASE WHEN t > 0 THEN greatest(a, b, c) / t END, 6) AS pay FROM s""")
def features_concentration(spark: SparkSession, sf: str) -> DataFrame:
    p = lambda s, sign=1: F.sum(F.when(F.col("o_orderstatus") == s, sign * F.col("o_totalprice")))
    df = t(spark, sf, "orders").groupBy("o_custkey").agg(p("F").alias("A_TUTAR"), p("O").alias("B_TUTAR"), p("P", -1).alias("C_TUTAR"))
    hhi, pay = features.concentration("T", ["A_TUTAR", "B_TUTAR", "C_TUTAR"]).values()
    return rounded(features.add(df, {"hhi": hhi, "pay": pay}).select("o_custkey", "hhi", "pay"), "hhi", "pay")


@R.add(f"""WITH c AS (SELECT list_sort(list_distinct([round(x, 6) FOR x IN quantile_cont(l_extendedprice, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])])) AS cuts FROM {ITEMS} WHERE tr)
SELECT CAST(len(list_filter(cuts, lambda x: x <= l_extendedprice)) + 1 AS DOUBLE) AS decile, count(*) AS n FROM {ITEMS}, c GROUP BY 1""")
def features_deciles(spark: SparkSession, sf: str) -> DataFrame:
    """Cuts from train rows, applied to all."""
    df = items(spark, sf)
    cuts = features.decile_cuts(df.where("tr"), ["l_extendedprice"])["l_extendedprice"]
    made = features.decile("l_extendedprice", cuts)
    return features.add(df, made).groupBy(F.col("l_extendedprice__DLM").alias("decile")).agg(F.count(F.lit(1)).alias("n"))


@R.add(f"""WITH g AS (SELECT l_returnflag, median(l_quantity) AS m, avg(l_quantity) AS mu, stddev_pop(l_quantity) AS sd, quantile_cont(l_quantity, [i / 20.0 FOR i IN range(21)]) AS q FROM {ITEMS} WHERE tr GROUP BY 1)
SELECT l_returnflag, l_quantity, count(*) AS n, round(any_value(CASE WHEN m <> 0 THEN l_quantity / m END), 6) AS gro, round(any_value((l_quantity - mu) / sd), 6) AS zs, round(any_value(len(list_filter(q, lambda x: x <= l_quantity)) / 21.0), 6) AS pct FROM {ITEMS} JOIN g USING (l_returnflag) GROUP BY 1, 2""")
def features_segments(spark: SparkSession, sf: str) -> DataFrame:
    df = items(spark, sf)
    learnt = features.learn_segments(df.where("tr"), "l_quantity", "l_returnflag")
    gro, zs, pct = features.by_segment("l_quantity", "l_returnflag", learnt).values()
    out = features.add(df, {"gro": gro, "zs": zs, "pct": pct})
    return rounded(out.groupBy("l_returnflag", "l_quantity").agg(F.count(F.lit(1)).alias("n"), *[F.first(c).alias(c) for c in ("gro", "zs", "pct")]), "gro", "zs", "pct")


def _encoded(kind: str) -> str:
    return f"""WITH b AS (SELECT l_orderkey, l_linenumber, CAST(l_partkey % 97 AS VARCHAR) AS k, y, tr, CAST(('0x' || substr(md5(l_orderkey || '|' || l_linenumber), 1, 8))::BIGINT % 5 AS INT) AS f FROM {ITEMS}),
c AS (SELECT k, f, count(*) AS n, sum(y) AS b FROM b WHERE tr GROUP BY 1, 2), a AS (SELECT k, sum(n) AS n, sum(b) AS b FROM c GROUP BY 1), t AS (SELECT f, sum(n) AS n, sum(b) AS b FROM c GROUP BY 1), z AS (SELECT sum(n) AS n, sum(b) AS b FROM c),
j AS (SELECT b.l_orderkey, b.l_linenumber, b.k, b.tr, a.n - CASE WHEN b.tr THEN coalesce(c.n, 0) ELSE 0 END AS n, a.b - CASE WHEN b.tr THEN coalesce(c.b, 0) ELSE 0 END AS bad, z.n - CASE WHEN b.tr THEN t.n ELSE 0 END AS an, z.b - CASE WHEN b.tr THEN t.b ELSE 0 END AS ab, a.n AS raw, z.n AS zn
FROM b CROSS JOIN z LEFT JOIN a ON a.k = b.k LEFT JOIN c ON c.k = b.k AND c.f = b.f LEFT JOIN t ON t.f = b.f)
SELECT l_orderkey, l_linenumber, round({kind}, 6) AS v FROM j"""


def _encode(spark: SparkSession, sf: str, kind: str) -> DataFrame:
    df = items(spark, sf).withColumn("k", (F.col("l_partkey") % 97).cast("string"))
    out = features.encode(df, F.col("tr"), "k", "y", ["l_orderkey", "l_linenumber"], (kind,))
    return rounded(out.select("l_orderkey", "l_linenumber", F.col(f"k__{kind.upper()}").alias("v")), "v")


@R.add(_encoded("CASE WHEN coalesce(n, 0) > 0 THEN ln((n - bad + 0.5) / (an - ab + 0.5)) - ln((bad + 0.5) / (ab + 0.5)) ELSE 0 END"))
def encode_woe(spark: SparkSession, sf: str) -> DataFrame:
    """Weight of evidence, out of fold on train rows."""
    return _encode(spark, sf, "woe")


@R.add(_encoded("CASE WHEN coalesce(n, 0) > 0 THEN (bad + 20 * (ab / an)) / (n + 20) ELSE ab / an END"))
def encode_target_mean(spark: SparkSession, sf: str) -> DataFrame:
    return _encode(spark, sf, "te")


@R.add(_encoded("coalesce(raw / zn, 0)"))
def encode_frequency(spark: SparkSession, sf: str) -> DataFrame:
    return _encode(spark, sf, "frk")


@R.add(f"""WITH c AS (SELECT coalesce(l_returnflag, '__BOS__') || '|' || l_linestatus AS k FROM {ITEMS}) SELECT k, count(*) AS n, CAST(k = 'A|F' AS DOUBLE) AS oh FROM c GROUP BY k""")
def encode_crossed(spark: SparkSession, sf: str) -> DataFrame:
    """Two categories as one, and one of its values as a 0/1 column."""
    df = items(spark, sf).withColumn("k", features.crossed("l_returnflag", "l_linestatus"))
    made = features.one_hot("k", ["A|F"])
    return features.add(df, made).groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("k__OH_A_F").alias("oh"))


@R.add(f"""WITH s AS (SELECT disc AS x FROM {ITEMS} WHERE disc IS NOT NULL) SELECT 'disc' AS "column", min(x) AS least, max(x) AS most, count(DISTINCT x) AS "distinct", 0.0 AS zero_share, FALSE AS has_negative, round(skewness(x), 6) AS skew, round(max(x) / quantile_cont(x, 0.99), 6) AS reach FROM s""")
def features_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Bias-corrected skewness and reach, from the distinct-value table."""
    return rounded(features.column_summary(items(spark, sf), ["disc"]), "skew", "reach")


# ---- expressions -----------------------------------------------------------------------------


@R.add(f"""WITH r AS (SELECT l_orderkey, l_linenumber, disc, l_quantity, (rank() OVER (PARTITION BY disc IS NULL ORDER BY disc) + (count(*) OVER (PARTITION BY disc) - 1) / 2.0) / count(disc) OVER () AS rk FROM {ITEMS})
SELECT l_orderkey, l_linenumber, round(CASE WHEN disc IS NOT NULL THEN ln(1 + greatest(disc, 0)) END, 6) AS a, round(CASE WHEN disc - 0.05 <> 0 THEN l_quantity / (disc - 0.05) END, 4) AS b, round(CASE WHEN disc IS NOT NULL THEN sqrt(greatest(disc - 0.05, 0)) END, 6) AS c,
round(CASE WHEN disc IS NOT NULL THEN least(greatest(disc, 0.02), 0.07) END, 6) AS d, round(CASE WHEN disc IS NOT NULL THEN rk END, 6) AS e FROM r""")
def expression_language(spark: SparkSession, sf: str) -> DataFrame:
    """The restricted language, compiled: zero division, guarded logarithm and root, clip, rank over the whole table."""
    steps = [("a", "log1p(disc)"), ("b", "l_quantity / fark(disc, 0.05)"), ("c", "sqrt(disc - 0.05)"), ("d", "clip(disc, 0.02, 0.07)"), ("e", "rank(disc)")]
    out = language.apply(items(spark, sf).select("l_orderkey", "l_linenumber", "disc", "l_quantity"), steps).drop("disc", "l_quantity")
    return rounded(rounded(out, "a", "c", "d", "e"), "b", places=4)


# ---- measures, binning, stability -------------------------------------------------------------

_AUC = """SELECT count(*) FILTER (y = 1) AS n_bad, count(*) FILTER (y = 0) AS n_good, (sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)) AS auc
FROM (SELECT y, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS r FROM ({}))"""


@R.add(f"""WITH a AS ({_AUC.format(f"SELECT y, l_extendedprice AS x FROM {ITEMS}")}), v AS (SELECT l_extendedprice AS x, count(*) FILTER (y = 1) AS b, count(*) FILTER (y = 0) AS g FROM {ITEMS} GROUP BY 1),
k AS (SELECT max(abs(cb / tb - cg / tg)) AS ks FROM (SELECT sum(b) OVER w AS cb, sum(g) OVER w AS cg, sum(b) OVER () AS tb, sum(g) OVER () AS tg FROM v WINDOW w AS (ORDER BY x)))
SELECT n_bad, n_good, round(auc, 6) AS auc, round(2 * auc - 1, 6) AS gini, round(ks, 6) AS ks FROM a, k""")
def measure_separation(spark: SparkSession, sf: str) -> DataFrame:
    """AUC, Gini and KS from counts of distinct values: no global rank."""
    return rounded(select.score_metrics(items(spark, sf), "l_extendedprice", "y"), "auc", "gini", "ks")


@R.add(f"""WITH b AS (SELECT l_returnflag || l_linestatus AS b, count(*) FILTER (y = 1) AS bad, count(*) FILTER (y = 0) AS good FROM {ITEMS} GROUP BY 1), t AS (SELECT sum(bad) AS tb, sum(good) AS tg, count(*) AS k FROM b),
p AS (SELECT b, bad, good, (bad + 0.5) / (tb + 0.5 * k) AS pb, (good + 0.5) / (tg + 0.5 * k) AS pg FROM b, t) SELECT b, bad, good, round(ln(pb / pg), 6) AS woe, round(sum((pb - pg) * ln(pb / pg)) OVER (), 6) AS iv FROM p""")
def measure_woe_iv(spark: SparkSession, sf: str) -> DataFrame:
    df = items(spark, sf).groupBy(F.concat("l_returnflag", "l_linestatus").alias("b")).agg(F.count_if(F.col("y") > 0).alias("bad"), F.count_if(F.col("y") <= 0).alias("good"))
    value = measures.information_value(df, []).first().iv
    return rounded(measures.bin_woe(df, []).withColumn("iv", F.lit(value)), "woe", "iv")


@R.add(f"""WITH v AS (SELECT disc AS x, tax AS w FROM {ITEMS} WHERE disc IS NOT NULL AND tax IS NOT NULL), r AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS a, rank() OVER (ORDER BY w) + (count(*) OVER (PARTITION BY w) - 1) / 2.0 AS b FROM v)
SELECT round(corr(a, b), 6) AS rho, count(*) AS n FROM r""")
def measure_spearman(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(features.spearman(items(spark, sf), "disc", "tax"), "rho")


@R.add(f"""WITH c AS (SELECT coalesce(CAST(CAST(disc AS DOUBLE) AS VARCHAR), '-') AS b, count(*) FILTER (y = 1) AS bad, count(*) FILTER (y = 0) AS good FROM {ITEMS} WHERE tr GROUP BY 1), t AS (SELECT sum(bad) AS tb, sum(good) AS tg, count(*) AS k FROM c)
SELECT 'disc' AS "column", round(sum(((bad + 0.5) / (tb + 0.5 * k) - (good + 0.5) / (tg + 0.5 * k)) * ln(((bad + 0.5) / (tb + 0.5 * k)) / ((good + 0.5) / (tg + 0.5 * k)))), 6) AS iv, any_value(k) AS bins FROM c, t""")
def measure_candidate(spark: SparkSession, sf: str) -> DataFrame:
    """IV of a candidate feature: its few values are bins, and so are its nulls."""
    return rounded(features.candidate_iv(items(spark, sf).where("tr"), "disc", "y"), "iv")


_UPLIFT = {"kare": ["l_quantity"], "carpim": ["l_quantity", "disc"], "toplam": ["l_quantity", "l_linenumber"]}
_UPLIFT_SQL = f"""WITH t AS (SELECT *, l_quantity * l_quantity AS kare, l_quantity * disc AS carpim, l_quantity * 100 + l_linenumber * 37.0 AS toplam FROM {ITEMS} WHERE tr),
m AS (SELECT unnest(['l_quantity', 'disc', 'l_linenumber', 'kare', 'carpim', 'toplam']) AS k, unnest([l_quantity, disc, CAST(l_linenumber AS DOUBLE), kare, carpim, toplam]) AS x, y FROM t),
q AS (SELECT k, count(DISTINCT x) AS d, list_distinct(quantile_cont(x, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS cuts FROM m GROUP BY 1),
b AS (SELECT k, CASE WHEN x IS NULL THEN '-' WHEN d <= 10 THEN CAST(x AS VARCHAR) ELSE CAST(len(list_filter(cuts, lambda c: c < x)) AS VARCHAR) END AS b, count(*) FILTER (y = 1) AS bad, count(*) FILTER (y = 0) AS good FROM m JOIN q USING (k) GROUP BY 1, 2),
p AS (SELECT k, (bad + 0.5) / (sum(bad) OVER w + 0.5 * count(*) OVER w) AS pb, (good + 0.5) / (sum(good) OVER w + 0.5 * count(*) OVER w) AS pg FROM b WINDOW w AS (PARTITION BY k)),
iv AS (SELECT k, sum((pb - pg) * ln(pb / pg)) AS iv FROM p GROUP BY 1), pairs AS (SELECT * FROM (VALUES ('kare', 'l_quantity'), ('carpim', 'l_quantity'), ('carpim', 'disc'), ('toplam', 'l_quantity'), ('toplam', 'l_linenumber')) v(c, s)),
g AS (SELECT pairs.c, any_value(a.iv) AS iv, max(z.iv) AS source_iv FROM pairs JOIN iv a ON a.k = c JOIN iv z ON z.k = s GROUP BY 1),
r AS (SELECT y, {", ".join(f"CASE WHEN {c} IS NOT NULL THEN rank() OVER (PARTITION BY {c} IS NULL ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 END AS {c}" for c in ("l_quantity", "disc", "l_linenumber", "kare", "carpim", "toplam"))} FROM t),
rho AS (SELECT 'kare' AS c, abs(corr(kare, l_quantity)) AS r FROM r UNION ALL SELECT 'carpim', greatest(abs(corr(carpim, l_quantity)), abs(corr(carpim, disc))) FROM r UNION ALL SELECT 'toplam', greatest(abs(corr(toplam, l_quantity)), abs(corr(toplam, l_linenumber))) FROM r)
SELECT c AS "column", round(iv, 6) AS iv, round(source_iv, 6) AS source_iv, round(iv - source_iv, 6) AS gain, CASE WHEN iv - source_iv >= 0.02 THEN round(r, 6) END AS rho FROM g JOIN rho USING (c)"""


def _made(spark: SparkSession, sf: str) -> DataFrame:
    q = F.col("l_quantity")
    return items(spark, sf).where("tr").withColumns({"kare": q * q, "carpim": q * F.col("disc"), "toplam": q * 100 + F.col("l_linenumber") * 37.0})


@R.add(_UPLIFT_SQL)
def features_uplift(spark: SparkSession, sf: str) -> DataFrame:
    """What candidate features add to the information value of their sources, and how alike they order the rows."""
    out = uplift.measure(_made(spark, sf), _UPLIFT, "y", ["l_orderkey", "l_linenumber"])
    return rounded(out.select("column", "iv", "source_iv", "gain", "rho"), "iv", "source_iv", "gain", "rho")


@R.add()
def features_linear_gain(spark: SparkSession, sf: str) -> DataFrame:
    """What candidates add to a logistic model on their source, all models fitted in the same passes."""
    out = uplift.measure(_made(spark, sf), {"kare": ["l_quantity"], "carpim": ["disc"], "toplam": ["l_linenumber"]}, "y", ["l_orderkey", "l_linenumber"], ["kare", "carpim", "toplam"])
    return rounded(out.select("column", "linear_gain", "worth"), "linear_gain")


@R.add(f"""WITH v AS (SELECT l_quantity AS x, count(*) FILTER (y = 1) AS bad, count(*) FILTER (y = 0) AS good FROM {ITEMS} WHERE tr GROUP BY 1), c AS (SELECT *, coalesce(sum(good) OVER (ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gb FROM v)
SELECT 'l_quantity' AS "column", round(greatest(a, 1 - a), 6) AS c_value, greatest(a, 1 - a) > 0.95 AS leak FROM (SELECT sum(bad * (gb + good / 2.0)) / (sum(bad) * sum(good)) AS a FROM c)""")
def single_factor(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(binning.single_factor(items(spark, sf).where("tr"), ["l_quantity"], "y").drop("iv"), "c_value")


_FACTORS = f"(SELECT *, CASE WHEN l_linestatus = 'F' THEN l_returnflag END AS flag, CAST(l_partkey % 97 AS VARCHAR) AS part, CASE WHEN l_partkey % 5 <> 0 THEN y END AS t, CAST(('0x' || substr(md5(l_orderkey || '|' || l_linenumber), 1, 8))::BIGINT % 5 AS INT) AS f FROM {ITEMS} WHERE tr)"
_AUC = "greatest(a, 1 - a)"


def _scored(c: str) -> str:
    """SQL of one numeric variable's five C-values."""
    score = ("x", "least(greatest(x, lo), hi)", "sign(x) * ln(1 + abs(x))", "exp(least(greatest((x - least) / coalesce(nullif(most - least, 0), 1), -5), 5))", "cd")
    auc = ", ".join(f"(sum(CASE WHEN t > 0 THEN r{i} END) - n1 * (n1 + 1) / 2.0) / (n1 * n0) AS a{i}" for i in range(5))
    ranks = ", ".join(f"rank() OVER (ORDER BY s{i}) + (count(*) OVER (PARTITION BY s{i}) - 1) / 2.0 AS r{i}" for i in range(5))
    return f"""SELECT '{c}' AS variable, 'numeric' AS type, fill, missing, {", ".join(f"round(greatest(a{i}, 1 - a{i}), 6) AS {w}" for i, w in enumerate(single.SCORES))}, 'measured' AS result FROM (
SELECT fill, missing, {auc} FROM (SELECT t, fill, missing, count(*) FILTER (t > 0) OVER () AS n1, count(*) FILTER (t <= 0) OVER () AS n0, {ranks} FROM (
SELECT t, fill, missing, {", ".join(f"{e} AS s{i}" for i, e in enumerate(score))} FROM (SELECT *, cume_dist() OVER (ORDER BY x) AS cd FROM (SELECT t, coalesce({c}, m) AS x, m AS fill, missing FROM {_FACTORS}, (SELECT median({c}) AS m, count(*) - count({c}) AS missing FROM {_FACTORS}))),
(SELECT quantile_cont(x, 0.05) AS lo, quantile_cont(x, 0.95) AS hi, min(x) AS least, max(x) AS most FROM (SELECT coalesce({c}, m) AS x FROM {_FACTORS}, (SELECT median({c}) AS m FROM {_FACTORS})))) WHERE t IS NOT NULL) GROUP BY fill, missing, n1, n0)"""


_RATED = f"""SELECT 'flag' AS variable, 'categorical' AS type, CAST(NULL AS DOUBLE) AS fill, missing, {", ".join(f"round({_AUC}, 6) AS {w}" for w in single.SCORES)}, 'measured' AS result FROM (
SELECT missing, (sum(CASE WHEN t > 0 THEN r END) - n1 * (n1 + 1) / 2.0) / (n1 * n0) AS a FROM (SELECT t, missing, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS r, count(*) FILTER (t > 0) OVER () AS n1, count(*) FILTER (t <= 0) OVER () AS n0 FROM (
SELECT t, missing, coalesce((bv - bvf) / nullif(nv - nvf, 0), (bk - bf) / nullif(nk - nf, 0)) AS s FROM (SELECT t, count(*) FILTER (flag IS NULL) OVER () AS missing, CAST(sum(t) OVER (PARTITION BY flag) AS DOUBLE) AS bv, count(t) OVER (PARTITION BY flag) AS nv, sum(t) OVER (PARTITION BY flag, f) AS bvf, count(t) OVER (PARTITION BY flag, f) AS nvf,
CAST(sum(t) OVER () AS DOUBLE) AS bk, count(t) OVER () AS nk, sum(t) OVER (PARTITION BY f) AS bf, count(t) OVER (PARTITION BY f) AS nf FROM {_FACTORS}) WHERE t IS NOT NULL)) GROUP BY missing, n1, n0)
UNION ALL SELECT 'part', 'categorical', NULL, count(*) - count(part), NULL, NULL, NULL, NULL, NULL, 'left out' FROM {_FACTORS}"""


@R.add(" UNION ALL ".join(_scored(c) for c in ("l_quantity", "disc", "tax", "l_extendedprice")) + " UNION ALL " + _RATED)
def single_factors(spark: SparkSession, sf: str) -> DataFrame:
    """Fills and C-values (raw, clipped, log, exp, rank) of numbers and categories, all from one value table each."""
    part = (F.col("l_partkey") % 97).cast("string")
    df = items(spark, sf).withColumns({"flag": F.when(F.col("l_linestatus") == "F", F.col("l_returnflag")), "part": part, "t": F.when(F.col("l_partkey") % 5 != 0, F.col("y"))})
    out = single.single_factors(df, ["l_quantity", "disc", "tax", "l_extendedprice"], ["flag", "part"], "t", F.col("tr"), ["l_orderkey", "l_linenumber"])
    return rounded(out.select("variable", "type", "fill", "missing", *single.SCORES, "result"), *single.SCORES)


_ORDERED = {"a_price": "l_extendedprice", "b_twice": "l_extendedprice * 2 + 1", "c_minus": "-l_extendedprice", "d_disc": "disc", "e_disc": "100 * disc", "f_filled": "coalesce(disc, 0)", "g_cut": "least(l_extendedprice, 20000)", "h_tax": "tax"}
_RANKED = f"(SELECT {', '.join(f'CASE WHEN {c} IS NOT NULL THEN dense_rank() OVER (ORDER BY {c} NULLS LAST) END AS {c}, CASE WHEN {c} IS NOT NULL THEN dense_rank() OVER (ORDER BY {c} DESC NULLS LAST) END AS {c}_d' for c in _ORDERED)} FROM (SELECT {', '.join(f'{e} AS {c}' for c, e in _ORDERED.items())} FROM {ITEMS}))"
_PAIRS = ", ".join(f"bool_and({a} IS NOT DISTINCT FROM {b}) AS {a}__{b}, bool_and({a} IS NOT DISTINCT FROM {b}_d) AS {a}__{b}_d" for a in _ORDERED for b in _ORDERED if a < b)


@R.add(f"""WITH p AS (SELECT {_PAIRS} FROM {_RANKED}), l AS ({" UNION ALL ".join(f"SELECT '{b}' AS b, '{a}' AS a, CASE WHEN {a}__{b} THEN 'same' WHEN {a}__{b}_d THEN 'opposite' END AS d FROM p" for a in _ORDERED for b in _ORDERED if a < b)}),
f AS (SELECT b AS "column", min(a) AS first, min_by(d, a) AS direction FROM l WHERE d IS NOT NULL GROUP BY 1) SELECT * FROM f UNION ALL SELECT DISTINCT first, first, 'same' FROM f""")
def columns_same_order(spark: SparkSession, sf: str) -> DataFrame:
    """Columns that order all rows alike, or the other way round, by order-free fingerprints of their ranks."""
    df = items(spark, sf).select("l_orderkey", "l_linenumber", *[F.expr(e).alias(c) for c, e in _ORDERED.items()])
    return single.same_order(df, list(_ORDERED), ["l_orderkey", "l_linenumber"])


@R.add()
def binning_proposals(spark: SparkSession, sf: str) -> DataFrame:
    """Supervised binning of several variables: fine bins in one pass, merging by grouped functions."""
    sets = F.when(F.col("tr"), variables.TRAIN).otherwise("test")
    out = variables.proposals(items(spark, sf), ["l_quantity", "l_extendedprice", "disc", "tax"], ["l_returnflag", "l_linestatus"], "y", sets)
    return rounded(out.withColumn("test", F.col("consistency")["test"]).drop("consistency"), "iv", "c", "iv_bins", "iv_median")


_CUTS = f"""WITH RECURSIVE v AS (SELECT k, x, CAST(sum(n) OVER (PARTITION BY k ORDER BY x) AS DOUBLE) AS upto, CAST(sum(n) OVER (PARTITION BY k) AS DOUBLE) AS total, count(*) OVER (PARTITION BY k) AS d, max(x) OVER (PARTITION BY k) AS last
FROM (SELECT k, x, count(*) AS n FROM (SELECT unnest(['l_quantity', 'l_extendedprice', 'disc', 'tax']) AS k, unnest([l_quantity, l_extendedprice, disc, tax]) AS x FROM {ITEMS} WHERE tr) WHERE x IS NOT NULL GROUP BY 1, 2)),
r AS (SELECT DISTINCT k, CAST(20 AS BIGINT) AS b, CAST(0 AS DOUBLE) AS done, CAST(NULL AS DOUBLE) AS cut FROM v WHERE d > 20
UNION ALL SELECT r.k, r.b - 1, min(v.upto), min(v.x) FROM r JOIN v ON v.k = r.k AND v.upto - r.done >= (v.total - r.done) / r.b AND v.x < v.last WHERE r.b > 1 GROUP BY r.k, r.b),
c AS (SELECT k, cut FROM r WHERE cut IS NOT NULL UNION ALL SELECT k, x FROM v WHERE d <= 20 AND x < last),
a AS (SELECT k, list(cut) AS cuts FROM c GROUP BY 1), m AS (SELECT k, x, y, tr FROM (SELECT unnest(['l_quantity', 'l_extendedprice', 'disc', 'tax']) AS k, unnest([l_quantity, l_extendedprice, disc, tax]) AS x, y, tr FROM {ITEMS}))
SELECT k, CASE WHEN tr THEN 'train' ELSE 'test' END AS s, CASE WHEN x IS NULL THEN -1 ELSE len(list_filter(cuts, lambda c: c < x)) END AS b, count(*) AS n, CAST(sum(y) AS BIGINT) AS bad, min(x) AS low, max(x) AS high FROM m JOIN a USING (k) GROUP BY 1, 2, 3"""


@R.add(_CUTS)
def binning_fine(spark: SparkSession, sf: str) -> DataFrame:
    """Equal-frequency bins of several variables together, nulls a bin of their own, counted in every set."""
    df, names = items(spark, sf), ["l_quantity", "l_extendedprice", "disc", "tax"]
    values = materialise(variables.value_counts(df, names, "y", F.when(F.col("tr"), variables.TRAIN).otherwise("test"), False), "values")
    return variables.fine_bins(values, variables.equal_cuts(materialise(variables.running(values), "running"))).drop("whole")


@R.add(f"""SELECT CASE WHEN disc IS NULL THEN 'Eksik' WHEN disc <= 0.03 THEN '≤ 0,03' WHEN disc <= 0.07 THEN '0,03 - 0,07' ELSE '> 0,07' END AS label, CASE WHEN l_returnflag = 'A' THEN 'G1' WHEN l_returnflag = 'N' THEN 'G2' ELSE 'Diğer' END AS grp, count(*) AS n FROM {ITEMS} GROUP BY 1, 2""")
def binning_apply(spark: SparkSession, sf: str) -> DataFrame:
    df = items(spark, sf).select(binning.apply_cuts("disc", [0.03, 0.07]).alias("label"), binning.apply_groups("l_returnflag", {"A": "G1", "N": "G2"}).alias("grp"))
    return df.groupBy("label", "grp").agg(F.count(F.lit(1)).alias("n"))


@R.add(f"""WITH q AS (SELECT list_sort(list_distinct(quantile_cont(tax, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS q FROM {ITEMS} WHERE tr AND tax IS NOT NULL), c AS (SELECT q[2:-2] AS cuts FROM q),
b AS (SELECT CASE WHEN tax IS NULL THEN -1 ELSE len(list_filter(cuts, lambda x: x < tax)) END AS b, count(*) FILTER (tr) AS e, count(*) FILTER (NOT tr) AS a FROM {ITEMS}, c GROUP BY 1), s AS (SELECT greatest(e / sum(e) OVER (), 0.0001) AS e, greatest(a / sum(a) OVER (), 0.0001) AS a FROM b)
SELECT 'tax' AS "column", round(sum((a - e) * ln(a / e)), 8) AS psi FROM s""")
def stability_numeric(spark: SparkSession, sf: str) -> DataFrame:
    df = items(spark, sf)
    return rounded(binning.psi_numeric(df.where("tr"), df.where("NOT tr"), "tax"), "psi", places=8)


@R.add(f"""WITH b AS (SELECT l_returnflag AS b, count(*) FILTER (tr) AS e, count(*) FILTER (NOT tr) AS a FROM {ITEMS} GROUP BY 1), s AS (SELECT greatest(e / sum(e) OVER (), 0.0001) AS e, greatest(a / sum(a) OVER (), 0.0001) AS a FROM b)
SELECT 'l_returnflag' AS "column", round(sum((a - e) * ln(a / e)), 8) AS psi FROM s""")
def stability_categorical(spark: SparkSession, sf: str) -> DataFrame:
    df = items(spark, sf)
    return rounded(binning.psi_categorical(df.where("tr"), df.where("NOT tr"), "l_returnflag"), "psi", places=8)


@R.add(f"""WITH c AS (SELECT list_sort(list_distinct(quantile_cont(l_extendedprice, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]))) AS cuts FROM {ITEMS} WHERE tr),
b AS (SELECT len(list_filter(cuts, lambda x: x <= l_extendedprice)) AS b, count(*) FILTER (tr) AS e, count(*) FILTER (NOT tr) AS a FROM {ITEMS}, c GROUP BY 1), s AS (SELECT greatest(e / sum(e) OVER (), 1e-6) AS e, greatest(a / sum(a) OVER (), 1e-6) AS a FROM b)
SELECT round(sum((a - e) * ln(a / e)), 8) AS psi FROM s""")
def stability_score(spark: SparkSession, sf: str) -> DataFrame:
    df = items(spark, sf)
    return rounded(select.score_psi(df.where("tr"), df.where("NOT tr"), "l_extendedprice"), "psi", places=8)


@R.add(f"""SELECT l_orderkey, l_linenumber, CAST(disc IS NULL AS INT) AS disc_EKSIK, CASE WHEN disc IS NULL THEN 'Eksik' WHEN disc <= 0.05 THEN '≤ 0,05' ELSE '> 0,05' END AS disc_ARALIK,
least(greatest(l_quantity, 5), 40) AS l_quantity_KIRP, round(ln(1 + l_extendedprice), 6) AS l_extendedprice_LOG FROM {ITEMS}""")
def decisions_apply(spark: SparkSession, sf: str) -> DataFrame:
    """Decisions on variables: bins, flags, winsor, logarithm; the raw columns leave."""
    df = items(spark, sf).select("l_orderkey", "l_linenumber", "disc", "l_quantity", "l_extendedprice")
    out = binning.apply_decisions(df, {"disc": {"cuts": [0.05], "flag": True}, "l_quantity": {"winsor": (5, 40)}, "l_extendedprice": {"log": True}})
    return rounded(out, "l_extendedprice_LOG")


# ---- remedies and text -------------------------------------------------------------------------


@R.add(f"""WITH f AS (SELECT k FROM (SELECT CAST(l_partkey % 97 AS VARCHAR) AS k, count(*) AS n FROM {ITEMS} WHERE tr GROUP BY 1 ORDER BY n DESC, k LIMIT 20)),
q AS (SELECT quantile_cont(l_extendedprice, 0.99) AS c FROM {ITEMS} WHERE tr AND l_extendedprice <> 0)
SELECT CASE WHEN CAST(l_partkey % 97 AS VARCHAR) IN (SELECT k FROM f) THEN CAST(l_partkey % 97 AS VARCHAR) ELSE 'Diğer' END AS g, count(*) AS n, round(sum(least(l_extendedprice, c)), 2) AS clipped, sum(CAST(disc IS NOT NULL AS INT)) AS filled, round(sum(coalesce(disc, -1)), 4) AS coded FROM {ITEMS}, q GROUP BY 1""")
def remedies_apply(spark: SparkSession, sf: str) -> DataFrame:
    """Rare values grouped, an upper clip, a filled flag, nulls as a code: learnt on train rows."""
    df = items(spark, sf).withColumn("k", (F.col("l_partkey") % 97).cast("string"))
    train = df.where("tr")
    cut = remedies.learn_upper_clip(train, "l_extendedprice")
    out = df.select(remedies.rare_group("k", remedies.learn_frequent(train, "k")).alias("g"), remedies.upper_clip("l_extendedprice", cut).alias("c"), remedies.filled_flag("disc").alias("f"), remedies.null_to_code("disc", -1).alias("m"))
    return rounded(rounded(out.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.sum("c").alias("clipped"), F.sum("f").alias("filled"), F.sum("m").alias("coded")), "clipped", places=2), "coded", places=4)


@R.add()
def remedies_target_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Categories grouped by their target rate on train rows."""
    df = items(spark, sf).withColumn("k", (F.col("l_partkey") % 23).cast("string"))
    groups = variables.target_groups(df.where("tr"), "k", "y", remedies.RARE)
    return variables.with_group(df, groups, "k", "g").groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("y"), 6).alias("rate"))


@R.add("""SELECT l_orderkey, l_linenumber, date_diff('day', CAST(l_shipdate AS DATE), last_day(CAST(l_shipdate AS DATE))) AS days, CASE WHEN l_orderkey % 50 = 0 THEN NULL ELSE CAST(l_shipdate AS DATE) END AS d FROM lineitem""")
def remedies_dates(spark: SparkSession, sf: str) -> DataFrame:
    li = t(spark, sf, "lineitem")
    d = F.when(F.col("l_orderkey") % 50 == 0, F.lit("9999-12-31").cast("date")).otherwise(F.col("l_shipdate").cast("date"))
    return li.select("l_orderkey", "l_linenumber", remedies.days_before_period_end(F.col("l_shipdate").cast("date"), F.date_format("l_shipdate", "yyyyMM")).alias("days"), remedies.sentinel_date_to_null(d).alias("d"))


_WORDS = "list_filter(list_distinct(regexp_extract_all(lower(replace(replace(text, 'I', 'ı'), 'İ', 'i')), '[a-zçğıöşüâîû]{2,}')), lambda w: NOT list_contains([" + ", ".join(f"'{w}'" for w in remedies.STOP) + "], w))"
_TEXTS = "(SELECT doc_id, text, quality AS y FROM documents JOIN labels USING (doc_id))"


@R.add(f"""WITH x AS (SELECT {_WORDS} AS w, y FROM {_TEXTS}), t AS (SELECT count(*) AS n, sum(y) AS b FROM x), g AS (SELECT word, count(*) AS n, sum(y) AS bad FROM (SELECT unnest(w) AS word, y FROM x) GROUP BY 1)
SELECT word, g.n, CAST(bad AS BIGINT) AS bad, round(ln((g.n - bad + 0.5) / (t.n - t.b + 0.5)) - ln((bad + 0.5) / (t.b + 0.5)), 6) AS woe FROM g, t WHERE g.n >= greatest(30, ceil(0.005 * t.n))""")
def text_words(spark: SparkSession, sf: str) -> DataFrame:
    """Word weights of evidence with a least support."""
    docs = t(spark, sf, "documents").join(t(spark, sf, "labels"), "doc_id")
    return rounded(remedies.word_table(docs, "text", "quality").drop("z"), "woe")


@R.add(f"""SELECT doc_id, len({_WORDS}) AS n_words, CAST(list_contains({_WORDS}, 'that') AS INT) AS has_that FROM documents""")
def text_features(spark: SparkSession, sf: str) -> DataFrame:
    out = remedies.text_features(t(spark, sf, "documents"), "text", ["that"])
    return out.select("doc_id", F.col("text__KELIME").alias("n_words"), F.col("text__K_that").alias("has_that"))


@R.add("""WITH d AS (SELECT DISTINCT text AS v FROM documents), s AS (SELECT DISTINCT source AS v FROM documents) SELECT 'text' AS "column", TRUE AS free UNION ALL SELECT 'source', FALSE""")
def text_free(spark: SparkSession, sf: str) -> DataFrame:
    return remedies.free_text(t(spark, sf, "documents"), ["text", "source"]).select("column", "free")


@R.add()
def text_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Mean word weight of a text, out of fold on train rows."""
    docs = t(spark, sf, "documents").join(t(spark, sf, "labels"), "doc_id", "left")
    out = remedies.text_score(docs, F.col("quality").isNotNull() & (F.col("doc_id") % 4 != 0), "text", "quality", ["doc_id"])
    return rounded(out.select("doc_id", "text__SKOR"), "text__SKOR")


# ---- selection, models, registry -----------------------------------------------------------------


@R.add(f"""SELECT * FROM (VALUES ('leak', FALSE, 'leak'), ('almost', FALSE, 'quasi constant'), ('times', FALSE, 'correlates with l_quantity'), ('l_quantity', TRUE, NULL), ('disc', TRUE, NULL)) v("column", kept, reason) WHERE (SELECT count(*) FROM {ITEMS}) > 0""")
def selection(spark: SparkSession, sf: str) -> DataFrame:
    """Leakage, quasi-constant and correlation filters with their reasons."""
    df = items(spark, sf).where("tr").select("y", "l_quantity", "disc", (F.col("l_quantity") * 2 + 1).alias("times"), F.when(F.col("l_orderkey") % 300 == 0, 1).otherwise(0).alias("almost"), (F.col("y") * 100 + F.col("l_linenumber")).alias("leak"))
    out = select.select(df, ["leak", "almost", "times", "l_quantity", "disc"], "y", {"l_quantity": 2.0, "times": 1.0})
    return out.withColumn("reason", F.regexp_replace("reason", " r=.*", ""))


_PAIRED = ("l_quantity", "l_extendedprice", "disc", "tax", "y", "gap")
_GAP = f"(SELECT *, CASE WHEN l_partkey % 3 <> 0 THEN l_quantity * (1 - disc) END AS gap FROM {ITEMS})"


@R.add(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, count(*) FILTER ({a} IS NOT NULL AND {b} IS NOT NULL) AS n, round(corr({a}, {b}), 6) AS r FROM {_GAP}" for i, a in enumerate(_PAIRED) for b in _PAIRED[i + 1 :]))
def selection_correlations(spark: SparkSession, sf: str) -> DataFrame:
    """Correlations of all pairs of columns over rows where both are filled, from one pass."""
    df = items(spark, sf).withColumn("gap", F.when(F.col("l_partkey") % 3 != 0, F.col("l_quantity") * (1 - F.col("disc"))))
    return rounded(gram.correlations(df, _PAIRED), "r")


@R.add(f"""WITH c AS (SELECT coalesce(CAST(l_quantity > 10 AS INT) + CAST(l_quantity > 30 AS INT), -1) AS b, y, count(*) AS n FROM {ITEMS} GROUP BY 1, 2), s AS (SELECT n, sum(n) OVER (PARTITION BY b) AS nb, sum(n) OVER (PARTITION BY y) AS ny, sum(n) OVER () AS t FROM c)
SELECT 'l_quantity' AS "column", round(sum(n / t * ln(n * t / (nb * ny))), 6) AS mi FROM s""")
def selection_mutual_information(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(select.mutual_information(items(spark, sf), "l_quantity", "y", (10.0, 30.0)), "mi")


def _digamma(n: str) -> str:
    x = f"(CAST({n} AS DOUBLE) + 10)"
    steps = " - ".join(f"1 / (CAST({n} AS DOUBLE) + {i})" for i in range(10))
    return f"(ln({x}) - 1 / (2 * {x}) - 1 / (12 * {x} * {x}) + 1 / (120 * pow({x}, 4)) - 1 / (252 * pow({x}, 6)) + 1 / (240 * pow({x}, 8)) - {steps})"


_LINE_NUMBERS = ("amount", "quantity", "discount")
_SIDES = ", ".join(f"coalesce(v - lag(v, {j}) OVER w, 'inf'::DOUBLE) AS a{j}, coalesce(lead(v, {j}) OVER w - v, 'inf'::DOUBLE) AS b{j}" for j in (1, 2, 3))


@R.add(f"""WITH p AS ({" UNION ALL ".join(f"SELECT '{c}' AS k, coalesce(flag = 'returned', false) AS y, CASE WHEN isfinite(CAST({c} AS DOUBLE)) THEN CAST({c} AS DOUBLE) ELSE 0 END AS v FROM sale_lines" for c in _LINE_NUMBERS)}),
s AS (SELECT k, y, v, count(*) OVER (PARTITION BY k, y) AS ny, count(*) OVER (PARTITION BY k) AS n, count(*) OVER (PARTITION BY k, y, v) AS c, {_SIDES} FROM p WINDOW w AS (PARTITION BY k, y ORDER BY v)),
r AS (SELECT k, y, v, ny, n, c, least(b3, greatest(a1, b2), greatest(a2, b1), a3) AS r FROM s),
u AS (SELECT k, v, count(*) AS here, CAST(sum(count(*)) OVER (PARTITION BY k ORDER BY v) AS BIGINT) AS upto FROM p GROUP BY k, v),
e AS (SELECT r.*, CASE WHEN r > 0 THEN v - r ELSE v END AS lo, CASE WHEN r > 0 THEN v + r ELSE v END AS hi FROM r),
m AS (SELECT e.*, CASE WHEN e.r > 0 THEN coalesce(h.upto, 0) - coalesce(l.upto, 0) ELSE o.here END AS m FROM e ASOF LEFT JOIN u AS h ON e.k = h.k AND e.hi > h.v ASOF LEFT JOIN u AS l ON e.k = l.k AND e.lo >= l.v JOIN u AS o ON o.k = e.k AND o.v = e.v)
SELECT k AS variable, count(*) AS "rows", round(greatest(avg({_digamma("n")} + {_digamma("CASE WHEN r > 0 THEN 3 ELSE c END")} - {_digamma("ny")} - {_digamma("m")}), 0), 6) AS mi FROM m GROUP BY k""")
def selection_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    """What amounts, quantities and discounts tell about a return, by nearest neighbours."""
    lines = t(spark, sf, "sale_lines").select(*_LINE_NUMBERS, (F.col("flag") == "returned").cast("int").alias("returned"))
    return rounded(neighbours.information(lines, _LINE_NUMBERS, "returned"), "mi")


__all__ = ["R", "Window"]
