"""Queries of spellings, dictionaries, names, the registry and the gate, over whole tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.functions import periods
from tabloom.operators import checks, columns, convert, dictionary, profile, select, uplift
from tabloom.plans import feature_queries, profile_queries
from tabloom.plans.base import ITEMS, MONTH, Registry, items, rounded, t

R = Registry()

_FORMS = (("yyyyMM", "%Y%m"), ("MM/yyyy", "%m/%Y"), ("yyyyMMdd", "%Y%m%d"), ("yyyy-MM-dd", "%Y-%m-%d"), ("yyyy\'M\'MM", "%YM%m"))


@R.add(" UNION ALL ".join(f"SELECT '{sql}' AS form, {MONTH} AS m, count(*) AS n FROM orders GROUP BY 2" for _, sql in _FORMS))
def period_spellings(spark: SparkSession, sf: str) -> DataFrame:
    """Order dates in five spellings of a period; each column decodes by the format that all its values have."""
    df = t(spark, sf, "orders").select(*[F.date_format("o_orderdate", form).alias(f"p{i}") for i, (form, _) in enumerate(_FORMS)])
    parts = [df.select(F.lit(sql).alias("form"), periods.month_index(df, f"p{i}", periods.decide(df, f"p{i}")).alias("m")) for i, (_, sql) in enumerate(_FORMS)]
    return reduce(DataFrame.unionAll, parts).groupBy("form", "m").agg(F.count(F.lit(1)).alias("n"))


_BAD = "o_orderkey % 10 = 3"
_DAY = "CAST(strftime(o_orderdate, '%Y%m%d') AS DOUBLE)"
_VALUES = {
    "sayisal_nokta": "round(o_totalprice, 2)", "sayisal_virgul": "round(o_totalprice, 2)", "tarih_ymd": _DAY, "tarih_dmy": _DAY, "tarih_ymd8": _DAY, "tarih_ym6": "CAST(strftime(o_orderdate, '%Y%m') || '01' AS DOUBLE)",
    "donem_ym6": "CAST(strftime(o_orderdate, '%Y%m') AS DOUBLE)", "donem_ymd8": _DAY, "kategorik_metin": "CAST(o_orderkey % 50 AS DOUBLE)", "kategorik_ay": "CAST(strftime(o_orderdate, '%Y%m') AS DOUBLE)", "kategorik_yil": "CAST(year(o_orderdate) AS DOUBLE)", "sayisal_ymd8": _DAY,
}


@R.add(" UNION ALL ".join(f"SELECT '{code}' AS code, count(*) AS n, count(*) FILTER ({ok}) AS fits, round(sum({v}) FILTER ({ok}), 2) AS total FROM orders" for code, v in _VALUES.items() for ok in ["TRUE" if code == "kategorik_metin" else f"NOT ({_BAD})"]))
def conversions(spark: SparkSession, sf: str) -> DataFrame:
    """Every conversion code on a whole column of its spelling, a tenth of it misspelt; dates count as eight digits."""
    day = lambda form: F.date_format("o_orderdate", form)
    price = F.format_number("o_totalprice", 2)
    raw = {
        "sayisal_nokta": (price, "12,34"), "sayisal_virgul": (F.translate(price, ",.", ".,"), "12.34"), "tarih_ymd": (day("yyyy-MM-dd"), "2024-13-01"), "tarih_dmy": (day("dd.MM.yyyy"), "31/01/2024"), "tarih_ymd8": (day("yyyyMMdd"), "20241301"), "tarih_ym6": (day("yyyyMM"), "202413"),
        "donem_ym6": (day("yyyyMM"), "2024"), "donem_ymd8": (day("yyyyMMdd"), "20230229"), "kategorik_metin": (F.concat((F.col("o_orderkey") % 50).cast("string"), F.lit(".0")), None), "kategorik_ay": (day("yyyy-MM-dd"), "x"), "kategorik_yil": (day("dd.MM.yyyy"), "1.1"), "sayisal_ymd8": (day("yyyy-MM-dd"), "-"),
    }
    bad = F.expr(_BAD)
    cells = F.explode(F.array(*[F.struct(F.lit(code).alias("code"), (F.when(bad, F.lit(wrong)).otherwise(good) if wrong else good).alias("raw")) for code, (good, wrong) in raw.items()]))
    df = t(spark, sf, "orders").select(cells.alias("c")).select("c.*")
    value = F.lit(None).cast("double")
    for code in convert.CODES:
        c = convert.convert(F.col("raw"), code, T.StringType())
        number = F.date_format(c, "yyyyMMdd").try_cast("double") if code.startswith("tarih") else F.regexp_replace(c.cast("string"), "-(?=[0-9]{2}$)", "").try_cast("double")
        value = F.when(F.col("code") == code, number).otherwise(value)
    return rounded(df.withColumn("v", value).groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.count("v").alias("fits"), F.sum("v").alias("total")), "total", places=2)


@R.add("""WITH o AS (SELECT strftime(o_orderdate, '%Y%m') AS ym, strftime(o_orderdate, '%Y%m%d') AS ymd, strftime(o_orderdate, '%Y-%m-%d') AS iso, CAST(o_totalprice AS VARCHAR) AS price, lpad(CAST(o_orderkey AS VARCHAR), 10, '0') AS code, o_orderkey % 20 AS STATUS_KOD FROM orders)
SELECT 'ym' AS "column", 'donem_ym6' AS code FROM o HAVING bool_and(try_strptime(ym || '01', '%Y%m%d') IS NOT NULL) UNION ALL SELECT 'ymd', 'tarih_ymd8' FROM o HAVING bool_and(try_strptime(ymd, '%Y%m%d') IS NOT NULL)
UNION ALL SELECT 'iso', 'tarih_ymd' FROM o HAVING bool_and(try_strptime(iso, '%Y-%m-%d') IS NOT NULL) UNION ALL SELECT 'price', 'sayisal_nokta' FROM o HAVING bool_and(try_cast(price AS DOUBLE) IS NOT NULL AND NOT regexp_matches(price, '^0[0-9]'))
UNION ALL SELECT 'code', 'sayisal_nokta' FROM o HAVING bool_and(NOT regexp_matches(code, '^0[0-9]')) UNION ALL SELECT 'STATUS_KOD', 'kategorik_metin' FROM o HAVING count(DISTINCT STATUS_KOD) BETWEEN 2 AND 50""")
def conversion_suggestions(spark: SparkSession, sf: str) -> DataFrame:
    """The first conversion that all values of a column fit, from one pass over the table."""
    df = t(spark, sf, "orders").select(
        F.date_format("o_orderdate", "yyyyMM").alias("ym"), F.date_format("o_orderdate", "yyyyMMdd").alias("ymd"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("iso"), F.col("o_totalprice").cast("string").alias("price"),
        F.lpad(F.col("o_orderkey").cast("string"), 10, "0").alias("code"), (F.col("o_orderkey") % 20).alias("STATUS_KOD"), "o_orderpriority",
    )
    return convert.suggestions(df, df.columns)


_MASKED = """SELECT email, CASE WHEN client_id % 3 = 0 THEN 'TR' || lpad(CAST(client_id AS VARCHAR), 24, '0') END AS account, CASE WHEN client_id % 2 = 0 THEN '+90 5' || lpad(CAST(client_id AS VARCHAR), 9, '0') ELSE city END AS contact,
CAST(10000000000 + client_id * 1009 % 90000000000 AS VARCHAR) AS no, lpad(CAST(client_id AS VARCHAR), 16, '4') AS card FROM clients"""
_DIGITS = "list_transform(range(1, 12), lambda i: CAST(no[i:i] AS INT))"


@R.add(f"""WITH c AS ({_MASKED}), m AS (SELECT unnest(['email', 'account', 'contact', 'no', 'card']) AS k, unnest([email, account, contact, no, card]) AS v FROM c), x AS (SELECT k, v, regexp_replace(regexp_replace(trim(v), '\\.0$', ''), '[\\s()-]', '', 'g') AS no FROM m WHERE v IS NOT NULL AND v <> ''),
d AS (SELECT *, CASE WHEN regexp_matches(no, '^[1-9][0-9]{{10}}$') THEN {_DIGITS} END AS d FROM x),
f AS (SELECT k, regexp_matches(no, '^[^@\\s]+@[^@\\s]+\\.[^@\\s]+$') AS eposta, regexp_matches(no, '^TR[0-9]{{24}}$') AS iban, regexp_matches(no, '^(\\+?90|0)?5[0-9]{{9}}$') AS telefon, regexp_matches(no, '^[0-9]{{16}}$') AS kart,
coalesce((((d[1] + d[3] + d[5] + d[7] + d[9]) * 7 - (d[2] + d[4] + d[6] + d[8])) % 10 + 10) % 10 = d[10] AND (d[1] + d[2] + d[3] + d[4] + d[5] + d[6] + d[7] + d[8] + d[9] + d[10]) % 10 = d[11], FALSE) AS kimlik FROM d),
g AS (SELECT k, count(*) AS filled, unnest(['eposta', 'iban', 'telefon', 'kart', 'kimlik']) AS pattern, unnest([count(*) FILTER (eposta), count(*) FILTER (iban), count(*) FILTER (telefon), count(*) FILTER (kart), count(*) FILTER (kimlik)]) AS matching FROM f GROUP BY k)
SELECT k AS "column", pattern, matching, filled, matching >= 0.3 * filled AS flagged FROM g""")
def profile_personal_data(spark: SparkSession, sf: str) -> DataFrame:
    """Patterns of personal data in the clients' e-mails, and in accounts, phones, ids and cards made from their numbers."""
    i = F.col("client_id")
    text = i.cast("string")
    df = t(spark, sf, "clients").select(
        "email", F.when(i % 3 == 0, F.concat(F.lit("TR"), F.lpad(text, 24, "0"))).alias("account"), F.when(i % 2 == 0, F.concat(F.lit("+90 5"), F.lpad(text, 9, "0"))).otherwise(F.col("city")).alias("contact"),
        (F.lit(10000000000) + i * 1009 % 90000000000).cast("string").alias("no"), F.lpad(text, 16, "4").alias("card"),
    )
    return profile.personal_data(df, df.columns)


@R.add("""SELECT * FROM (SELECT unnest(['client_id', 'MUSTERI_AD', 'E_POSTA', 'city', 'segment']) AS "column", unnest([FALSE, TRUE, TRUE, FALSE, FALSE]) AS personal, unnest([count(client_id), count(nullif(name, '')), count(nullif(email, '')), count(nullif(city, '')), count(nullif(segment, ''))]) AS filled FROM clients)""")
def columns_personal(spark: SparkSession, sf: str) -> DataFrame:
    """Which columns of the clients point at a person by their names, beside how full they are."""
    df = t(spark, sf, "clients").select("client_id", F.col("name").alias("MUSTERI_AD"), F.col("email").alias("E_POSTA"), "city", "segment")
    found = profile.profile(df).select("column", "filled")
    return columns.personal_names(found).join(found, "column")


@R.add(f"""WITH f AS ({profile_queries.R.sql["check_columns"]}), h AS (SELECT "column", finding FROM f UNION ALL SELECT "column", 'hidden_code' FROM ({profile_queries.R.sql["check_hidden_missing"]}) UNION ALL SELECT "column", 'extreme' FROM ({profile_queries.R.sql["check_extremes"]}))
SELECT "column", CASE WHEN bool_or(finding IN ('too_null', 'constant', 'id_like', 'near_constant', 'copy')) THEN 'drop' ELSE 'fix' END AS advice FROM h GROUP BY 1""")
def columns_advice(spark: SparkSession, sf: str) -> DataFrame:
    """Drop, fix or keep, from the battery's own findings on a table."""
    df = profile_queries._checked(spark, sf)
    rules = checks.column_rules(profile.profile(df, ["thin", "same", "rid", "almost", "city"])).select("column", "finding")
    hidden = checks.hidden_missing(df, ["coded", "mixed", "l_quantity", "far"]).select("column", F.lit("hidden_code").alias("finding"))
    far = checks.extremes(df, ["far", "l_quantity"]).select("column", F.lit("extreme").alias("finding"))
    return columns.advice(rules.unionAll(hidden).unionAll(far))


def _described(spark: SparkSession, sf: str) -> DataFrame:
    """Items as a dictionary: a name, a description that some rows lack, a category."""
    return t(spark, sf, "items").where("name IS NOT NULL").select(F.col("name").alias("DEGISKEN"), F.when(F.col("item_id") % 3 != 0, F.col("brand")).otherwise("").alias("ACIKLAMA"), F.col("kind").alias("KATEGORI"))


_DESCRIBED = "(SELECT name AS DEGISKEN, CASE WHEN item_id % 3 <> 0 THEN brand ELSE '' END AS ACIKLAMA, kind AS KATEGORI FROM items WHERE name IS NOT NULL)"


@R.add(f"""WITH d AS (SELECT trim(lower(DEGISKEN)) AS k, max(nullif(trim(ACIKLAMA), '')) IS NOT NULL AS said, min(nullif(trim(ACIKLAMA), '')) AS description, min(DEGISKEN) AS n FROM {_DESCRIBED} GROUP BY 1), c AS (SELECT DISTINCT upper(p_name) AS c FROM part)
SELECT coalesce(c, n) AS name, description, CASE WHEN c IS NULL THEN 'extra' WHEN k IS NULL THEN 'missing' ELSE 'match' END AS status FROM d FULL JOIN c ON k = lower(c)""")
def dictionary_match(spark: SparkSession, sf: str) -> DataFrame:
    """The items as a dictionary against the names of parts in capitals."""
    names = t(spark, sf, "part").select(F.upper("p_name").alias("column")).distinct()
    return dictionary.match(_described(spark, sf), names).select("name", "description", "status")


@R.add(f"""WITH r AS (SELECT p_name AS name, CASE WHEN p_partkey % 2 = 0 THEN p_type END AS d, 0 AS p FROM part WHERE p_name IS NOT NULL UNION ALL SELECT DEGISKEN, nullif(trim(ACIKLAMA), ''), 1 FROM {_DESCRIBED}), f AS (SELECT name, d FROM r WHERE d IS NOT NULL QUALIFY row_number() OVER (PARTITION BY name ORDER BY p, d) = 1)
SELECT r.name, any_value(f.d) AS description, count(DISTINCT r.d) AS conflicts FROM r LEFT JOIN f USING (name) GROUP BY 1""")
def dictionary_combine(spark: SparkSession, sf: str) -> DataFrame:
    """Parts and items as two dictionaries: the first description there is, and how many there are."""
    parts = t(spark, sf, "part").where("p_name IS NOT NULL").select(F.col("p_name").alias("DEGISKEN"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_type")).otherwise(" ").alias("ACIKLAMA"))
    return dictionary.combine([parts, _described(spark, sf)])


@R.add("""WITH d AS (SELECT name AS k, min(nullif(CASE WHEN item_id % 3 <> 0 THEN brand ELSE '' END, '')) AS a FROM items WHERE name IS NOT NULL GROUP BY 1), c AS (SELECT DISTINCT p_name AS c FROM part WHERE p_partkey % 4 <> 0), m AS (SELECT p_name AS name, min(p_type) AS description FROM part GROUP BY 1)
SELECT k AS "DEGISKEN", coalesce(a, description) AS "ACIKLAMA" FROM d JOIN c ON c = k LEFT JOIN m ON name = k UNION ALL SELECT name, description FROM m JOIN c ON c = name WHERE name NOT IN (SELECT k FROM d)""")
def dictionary_refresh(spark: SparkSession, sf: str) -> DataFrame:
    """The items' dictionary after some names left the table and others were generated."""
    known = _described(spark, sf).groupBy("DEGISKEN").agg(F.coalesce(F.min(F.nullif("ACIKLAMA", F.lit(""))), F.lit("")).alias("ACIKLAMA"))
    parts = t(spark, sf, "part")
    names = parts.where("p_partkey % 4 <> 0").select(F.col("p_name").alias("column")).distinct()
    return dictionary.refresh(known, names, parts.groupBy(F.col("p_name").alias("name")).agg(F.min("p_type").alias("description")))


@R.add("""WITH d AS (SELECT name AS s, min(kind) AS t FROM items WHERE name IS NOT NULL GROUP BY 1)
SELECT p_name || '_' || p_partkey AS name, CASE WHEN t IS NOT NULL THEN CASE WHEN p_size % 2 = 0 THEN t || ' (sum, son_' || p_size || 'a)' ELSE t END END AS description FROM part LEFT JOIN d ON s = p_name""")
def dictionary_inherit(spark: SparkSession, sf: str) -> DataFrame:
    """Every part as a column derived from the item of its name, by a sum over a window for every other one."""
    even = F.col("p_size") % 2 == 0
    lineage = t(spark, sf, "part").select(F.concat_ws("_", "p_name", "p_partkey").alias("column"), F.col("p_name").alias("source_column"), F.when(even, "sum").alias("function"), F.when(even, F.concat(F.lit("son_"), F.col("p_size"), F.lit("a"))).alias("window"))
    known = t(spark, sf, "items").where("name IS NOT NULL").groupBy(F.col("name").alias("DEGISKEN")).agg(F.min("kind").alias("ACIKLAMA"))
    return dictionary.inherit(lineage, known)


@R.add("""WITH i AS (SELECT list_distinct([upper(brand), upper(kind)]) AS t, list_distinct(regexp_extract_all(lower(name), '[a-zçğıöşüâîû]{3,}')) AS w FROM items WHERE brand IS NOT NULL AND kind IS NOT NULL AND name IS NOT NULL), n AS (SELECT count(*) AS n FROM i),
t AS (SELECT token, count(*) AS nt FROM (SELECT unnest(t) AS token FROM i) GROUP BY 1), w AS (SELECT word, count(*) AS nw FROM (SELECT unnest(w) AS word FROM i) GROUP BY 1), c AS (SELECT token, word, count(*) AS m FROM (SELECT token, unnest(w) AS word FROM (SELECT unnest(t) AS token, w FROM i)) GROUP BY 1, 2)
SELECT token, word, m AS n, round(m * n.n / CAST(nt * nw AS DOUBLE), 6) AS lift FROM c JOIN t USING (token) JOIN w USING (word), n WHERE m >= 3 AND m * n.n / CAST(nt * nw AS DOUBLE) >= 2""")
def names_abbreviations(spark: SparkSession, sf: str) -> DataFrame:
    """Words of the items' names that go with their brands and kinds, by support and lift."""
    df = t(spark, sf, "items").where("brand IS NOT NULL AND kind IS NOT NULL AND name IS NOT NULL")
    return rounded(dictionary.abbreviations(df.select(F.concat_ws("_", "brand", "kind").alias("name"), F.col("name").alias("description"))), "lift")


_COLUMN = "upper(replace(name, ' ', '_')) || CASE WHEN item_id % 5 = 0 THEN '_NEXT' || CAST(size AS INT) || 'M' WHEN item_id % 5 = 1 THEN '_SON' || CAST(size AS INT) || 'A_' || upper(kind) ELSE '_L' || CAST(size AS INT) || 'D' END"
_COLUMNS = f"(SELECT {_COLUMN} AS name FROM items WHERE name IS NOT NULL AND size IS NOT NULL AND kind IS NOT NULL)"


def _columns(spark: SparkSession, sf: str) -> DataFrame:
    """Items as names of columns with windows."""
    return t(spark, sf, "items").where("name IS NOT NULL AND size IS NOT NULL AND kind IS NOT NULL").select(F.expr(_COLUMN).alias("name"))


@R.add(f"""WITH t AS (SELECT DISTINCT name, regexp_replace(x, '[0-9]+', '#') AS pattern FROM (SELECT name, unnest(string_split(name, '_')) AS x FROM {_COLUMNS}) WHERE regexp_matches(x, '^((SON|L|LAST|PREV|NEXT|ILK|GELECEK)_?)?[0-9]{{1,3}}[DGWMAQY]$')),
c AS (SELECT name, count(*) AS m FROM {_COLUMNS} GROUP BY 1) SELECT pattern, CAST(sum(m) AS BIGINT) AS n, array_to_string(list_sort(list(name))[1:3], ',') AS examples FROM t JOIN c USING (name) GROUP BY 1""")
def names_periods(spark: SparkSession, sf: str) -> DataFrame:
    """Period patterns in names, with their counts and first examples."""
    return dictionary.pattern_table(_columns(spark, sf)).withColumn("examples", F.concat_ws(",", "examples"))


@R.add(f"""WITH n AS (SELECT name, list_filter(string_split(name, '_'), lambda x: x <> '') AS t FROM {_COLUMNS}), p AS (SELECT t[i] AS a, t[i + 1] AS b FROM (SELECT t, unnest(range(1, len(t))) AS i FROM n))
SELECT 'adjacent' AS what, a || ' ' || b AS text, count(*) AS n FROM p GROUP BY 2 HAVING count(*) >= 3 UNION ALL SELECT 'future', name, count(*) FROM n WHERE len(list_filter(t, lambda x: regexp_matches(x, '^(NEXT|GELECEK)_?[0-9]{{1,3}}[DGWMAQY]$'))) > 0 GROUP BY 2
UNION ALL SELECT 'standard', s, count(*) FROM (SELECT name, array_to_string(list_concat(list_filter(t, lambda x: NOT regexp_matches(x, '^((SON|L|LAST|PREV|NEXT|ILK|GELECEK)_?)?[0-9]{{1,3}}[DGWMAQY]$')), list_filter(t, lambda x: regexp_matches(x, '^((SON|L|LAST|PREV|NEXT|ILK|GELECEK)_?)?[0-9]{{1,3}}[DGWMAQY]$'))), '_') AS s FROM n) WHERE s <> name GROUP BY 2""")
def names_structure(spark: SparkSession, sf: str) -> DataFrame:
    """What names say: neighbouring words, windows that look ahead, names in the standard order of words."""
    df, name = _columns(spark, sf), F.col("name")
    near = dictionary.adjacent_table(df).select(F.lit("adjacent").alias("what"), F.concat_ws(" ", "first", "second").alias("text"), "n")
    ahead = df.where(dictionary.looks_ahead(name)).groupBy(F.lit("future").alias("what"), name.alias("text")).agg(F.count(F.lit(1)).alias("n"))
    other = df.withColumn("s", dictionary.standard(name)).where("s <> name").groupBy(F.lit("standard").alias("what"), F.col("s").alias("text")).agg(F.count(F.lit(1)).alias("n"))
    return near.unionByName(ahead).unionByName(other)


@R.add(f"""SELECT "column" AS name, CASE WHEN gain >= 0.02 AND coalesce(rho, 0) < 0.95 THEN 'SECILDI' ELSE 'ELENDI' END AS status, gain AS importance, iv FROM ({feature_queries.R.sql["features_uplift"]}) UNION ALL SELECT 'esik', '-', NULL, NULL""")
def feature_registry(spark: SparkSession, sf: str) -> DataFrame:
    """The registry of generated columns: measured on a table, chosen or not, one not measured."""
    got = uplift.measure(feature_queries._made(spark, sf), feature_queries._UPLIFT, "y", ["l_orderkey", "l_linenumber"])
    made = got.select(F.col("column").alias("name"), F.concat_ws(",", "sources").alias("source"), F.lit("").alias("formula")).unionAll(spark.createDataFrame([("esik", "l_quantity", "")], "name string, source string, formula string"))
    out = dictionary.registry(made, got.select("column", "iv", F.lit(None).cast("double").alias("psi")), got.select("column", F.col("worth").alias("kept"), F.col("gain").alias("importance")))
    return rounded(out.select("name", "status", "importance", "iv"), "importance", "iv")


_SETS = "(SELECT *, CASE WHEN tr THEN 'train' WHEN l_orderkey % 10 = 9 THEN 'oot' ELSE 'test' END AS s FROM " + ITEMS + ")"
_MARKS = " UNION ALL ".join(f"SELECT '{n}' AS criterion, {n} AS v, CASE WHEN {n} {'>=' if more else '<='} {good} THEN 'gecti' WHEN {n} {'>=' if more else '<='} {fair} THEN 'kosullu' ELSE 'kaldi' END AS mark FROM g" for n, good, fair, more in select.GATE)


@R.add(f"""WITH c AS (SELECT s, l_extendedprice AS x, count(*) FILTER (y = 1) AS b, count(*) FILTER (y = 0) AS g FROM {_SETS} GROUP BY 1, 2), r AS (SELECT *, sum(b) OVER w AS cb, sum(g) OVER w AS cg, sum(b) OVER (PARTITION BY s) AS tb, sum(g) OVER (PARTITION BY s) AS tg FROM c WINDOW w AS (PARTITION BY s ORDER BY x)),
m AS (SELECT s, 2 * sum(b * (cg - g / 2.0)) / any_value(tb * tg) - 1 AS gini, max(abs(cb / tb - cg / tg)) AS ks FROM r GROUP BY 1), q AS (SELECT list_sort(list_distinct(quantile_cont(l_extendedprice, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]))) AS cuts FROM {_SETS} WHERE s = 'train'),
p AS (SELECT len(list_filter(cuts, lambda z: z <= l_extendedprice)) AS b, count(*) FILTER (s = 'train') AS e, count(*) FILTER (s = 'test') AS a FROM {_SETS}, q WHERE s <> 'oot' GROUP BY 1), k AS (SELECT sum((a - e) * ln(a / e)) AS psi FROM (SELECT greatest(e / sum(e) OVER (), 1e-6) AS e, greatest(a / sum(a) OVER (), 1e-6) AS a FROM p)),
g AS (SELECT te.gini AS gini_test, te.ks AS ks_test, tr.gini - te.gini AS gini_drop, psi, o.gini AS gini_oot, o.ks AS ks_oot FROM m tr, m te, m o, k WHERE tr.s = 'train' AND te.s = 'test' AND o.s = 'oot'), x AS ({_MARKS})
SELECT criterion, mark, round(v, 6) AS value, CASE WHEN bool_or(mark = 'kaldi') OVER () THEN 'kaldi' WHEN bool_or(mark = 'kosullu') OVER () THEN 'kosullu' ELSE 'gecti' END AS verdict FROM x""")
def validation_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Six criteria of a score, measured on train, test and out-of-time rows: each passed, conditional or failed."""
    df = items(spark, sf).withColumn("s", F.when(F.col("tr"), "train").when(F.col("l_orderkey") % 10 == 9, "oot").otherwise("test"))
    got = {r.s: r for r in select.score_metrics(df, "l_extendedprice", "y", ["s"]).collect()}
    psi = select.score_psi(df.where("s = 'train'"), df.where("s = 'test'"), "l_extendedprice").first().psi
    values = {"gini_test": got["test"].gini, "ks_test": got["test"].ks, "gini_drop": got["train"].gini - got["test"].gini, "psi": psi, "gini_oot": got["oot"].gini, "ks_oot": got["oot"].ks}
    verdict, marks = select.gate(values)
    return spark.createDataFrame([(c, m, None if values[c] is None else round(values[c], 6), verdict) for c, m in marks], "criterion string, mark string, value double, verdict string")
