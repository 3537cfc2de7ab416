"""Data dictionaries, the feature registry, and what column names tell."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Sequence
from itertools import pairwise

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.functions.exprs import turkish_fold


def match(dictionary: DataFrame, columns: DataFrame) -> DataFrame:
    """(name, description, category, status) of a table's columns against a dictionary (DEGISKEN, ACIKLAMA, KATEGORI).

    Names meet exactly or folded; of several rows for one name one with a description is
    preferred. status: match, missing (in the table only), extra (in the dictionary only).
    """
    fold = lambda c: turkish_fold(F.trim(F.col(c)))
    best = Window.partitionBy("k").orderBy((F.coalesce(F.trim("ACIKLAMA"), F.lit("")) == ""), "ACIKLAMA", "DEGISKEN")
    rows = dictionary.withColumn("k", fold("DEGISKEN")).withColumn("r", F.row_number().over(best)).where("r = 1").drop("r")
    names = columns.select(F.col("column").alias("c")).withColumn("kc", fold("c"))
    status = F.when(F.col("c").isNull(), "extra").when(F.col("k").isNull(), "missing").otherwise("match")
    return rows.join(names, F.col("k") == F.col("kc"), "full_outer").select(F.coalesce("c", "DEGISKEN").alias("name"), F.nullif(F.trim("ACIKLAMA"), F.lit("")).alias("description"), F.col("KATEGORI").alias("category"), status.alias("status"))


def combine(dictionaries: Sequence[DataFrame]) -> DataFrame:
    """(name, description, conflicts): the first non-empty description in the given order, and how many different ones there are."""
    rows = None
    for i, d in enumerate(dictionaries):
        part = d.select(F.col("DEGISKEN").alias("name"), F.nullif(F.trim("ACIKLAMA"), F.lit("")).alias("description"), F.lit(i).alias("place"))
        rows = part if rows is None else rows.unionAll(part)
    first = F.min(F.when(F.col("description").isNotNull(), F.struct("place", "description")))["description"]
    return rows.groupBy("name").agg(first.alias("description"), F.count_distinct("description").alias("conflicts"))


def inherit(lineage: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(name, description): a derived column speaks of its source column's description. lineage: column, source_column, function, window."""
    d = dictionary.select(F.col("DEGISKEN").alias("source_column"), F.col("ACIKLAMA").alias("text"))
    how = F.concat_ws(" ", F.col("text"), F.when(F.col("function").isNotNull(), F.concat(F.lit("("), F.concat_ws(", ", "function", "window"), F.lit(")"))))
    return lineage.join(d, "source_column", "left").select(F.col("column").alias("name"), F.when(F.col("text").isNotNull(), how).alias("description"))


def refresh(dictionary: DataFrame, columns: DataFrame, made: DataFrame) -> DataFrame:
    """The working dictionary: rows of dropped columns go, generated columns (name, description) come, empty descriptions are filled."""
    stay = dictionary.join(columns.select(F.col("column").alias("DEGISKEN")), "DEGISKEN", "left_semi")
    known = stay.join(made.select(F.col("name").alias("DEGISKEN"), F.col("description").alias("d")), "DEGISKEN", "left").select("DEGISKEN", F.coalesce(F.nullif(F.trim("ACIKLAMA"), F.lit("")), "d").alias("ACIKLAMA"))
    new = made.join(stay.select(F.col("DEGISKEN").alias("name")), "name", "left_anti").join(columns.select(F.col("column").alias("name")), "name", "left_semi")
    return known.unionAll(new.select("name", "description"))


def registry(features: DataFrame, quality: DataFrame, selection: DataFrame) -> DataFrame:
    """The feature registry: features (name, source, formula) with quality (column, iv, psi) and selection (column, kept, importance).

    Selected ones first, then eliminated, then undecided; each by falling importance.
    """
    q, s = quality.withColumnRenamed("column", "name"), selection.withColumnRenamed("column", "name")
    status = F.when(F.col("kept").isNull(), "-").when(F.col("kept"), "SECILDI").otherwise("ELENDI")
    rank = F.when(F.col("status") == "SECILDI", 0).when(F.col("status") == "ELENDI", 1).otherwise(2)
    return features.join(q, "name", "left").join(s, "name", "left").withColumn("status", status).orderBy(rank, F.col("importance").desc_nulls_last(), "name")


# ---- names in tables: any number of them ----------------------------------------------------

_SPLIT = "_+|(?<=[a-zçğıöşü])(?=[A-ZÇĞİÖŞÜ])"
_PERIOD_WORD = "^((SON|L|LAST|PREV|NEXT|ILK|GELECEK)_?)?[0-9]{1,3}[DGWMAQY]$"


def name_tokens(name: Column) -> Column:
    """Parts of a name, as ``tokens``, in upper case."""
    return F.transform(F.filter(F.split(name, _SPLIT), lambda t: t != ""), lambda t: F.upper(t))


def pattern_table(names: DataFrame, name: str = "name") -> DataFrame:
    """(pattern, n, examples): period tokens with # for numbers, how many names hold one, the least three of them."""
    rows = names.where(F.col(name).isNotNull()).select(name, F.explode(F.array_distinct(F.transform(F.filter(name_tokens(F.col(name)), lambda t: t.rlike(_PERIOD_WORD)), lambda t: F.regexp_replace(t, "[0-9]+", "#")))).alias("pattern"))
    few = rows.groupBy("pattern", name).agg(F.count(F.lit(1)).alias("m"))
    best = few.withColumn("r", F.row_number().over(Window.partitionBy("pattern").orderBy(name))).where("r <= 3").groupBy("pattern").agg(F.sort_array(F.collect_list(name)).alias("examples"))
    return few.groupBy("pattern").agg(F.sum("m").alias("n")).join(best, "pattern")


def adjacent_table(names: DataFrame, support: int = 3, name: str = "name") -> DataFrame:
    """(first, second, n): neighbouring tokens that occur together at least ``support`` times."""
    t = name_tokens(F.col(name))
    pairs = F.arrays_zip(F.slice(t, 1, F.greatest(F.size(t) - 1, F.lit(0))).alias("first"), F.slice(t, 2, F.greatest(F.size(t) - 1, F.lit(0))).alias("second"))
    return names.where(F.col(name).isNotNull()).select(F.explode(pairs).alias("p")).groupBy("p.first", "p.second").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= support)


def looks_ahead(name: Column) -> Column:
    """Whether a name holds a window that lies in the future: such a column would leak."""
    return F.exists(name_tokens(name), lambda t: t.rlike("^(NEXT|GELECEK)_?[0-9]{1,3}[DGWMAQY]$"))


def standard(name: Column) -> Column:
    """Upper case, single underscores, window tokens last, as ``standard_name``."""
    t = name_tokens(name)
    return F.concat_ws("_", F.filter(t, lambda x: ~x.rlike(_PERIOD_WORD)), F.filter(t, lambda x: x.rlike(_PERIOD_WORD)))


# ---- names: small inputs, plain Python -------------------------------------------------------


def tokens(name: str) -> list[str]:
    """Parts of a column name: at underscores, at changes from lower to upper case, between letters and digits."""
    return [t for t in re.split(r"_+|(?<=[a-zçğıöşü])(?=[A-ZÇĞİÖŞÜ])", name) if t]


_PERIOD = re.compile(r"^(?:(SON|L|LAST|PREV|NEXT|ILK|GELECEK)_?)?([0-9]{1,3})([DGWMAQY])$", re.IGNORECASE)
_DIRECTION = {"SON": "last", "L": "last", "LAST": "last", "PREV": "before", "NEXT": "next", "GELECEK": "next", "ILK": "after", "": "duration"}


def period_meaning(token: str) -> tuple[str, int, str] | None:
    """(direction, length, unit) of a period token such as L30D, SON3A, NEXT6M."""
    m = _PERIOD.match(token)
    return (_DIRECTION[(m[1] or "").upper()], int(m[2]), m[3].upper()) if m else None


def period_patterns(names: Sequence[str]) -> dict[str, tuple[int, list[str]]]:
    """pattern with # for numbers -> (columns, up to three examples)."""
    found: dict[str, list[str]] = {}
    for n in names:
        for t in tokens(n):
            if period_meaning(t):
                found.setdefault(re.sub(r"[0-9]+", "#", t.upper()), []).append(n)
    return {p: (len(c), c[:3]) for p, c in sorted(found.items(), key=lambda x: (-len(x[1]), x[0]))}


def future_columns(names: Sequence[str]) -> list[str]:
    """Columns whose name looks ahead: they would leak."""
    return [n for n in names if any((m := period_meaning(t)) and m[0] == "next" for t in tokens(n))]


def adjacent(names: Sequence[str], support: int = 3) -> dict[tuple[str, str], int]:
    """Neighbouring tokens that occur together at least ``support`` times."""
    counts = Counter(p for n in names for p in pairwise(t.upper() for t in tokens(n)))
    return {p: n for p, n in sorted(counts.items(), key=lambda x: (-x[1], x[0])) if n >= support}


def edit_distance(a: str, b: str) -> int:
    """Insertions, deletions, substitutions and swaps of neighbours."""
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            best = min(rows[i - 1][j] + 1, row[j - 1] + 1, rows[i - 1][j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, rows[i - 2][j - 2] + 1)
            row.append(best)
        rows.append(row)
    return rows[-1][-1]


def skeleton(token: str) -> str:
    """The first letter and the consonants after it."""
    t = token.upper()
    return t[:1] + "".join(c for c in t[1:] if c not in "AEIİOÖUÜI")


def similar_tokens(names: Sequence[str]) -> list[list[str]]:
    """Groups of tokens of four letters or more with one skeleton or one edit between them."""
    known = sorted({t.upper() for n in names for t in tokens(n) if len(t) >= 4 and t.isalpha()})
    group = {t: t for t in known}

    def top(t: str) -> str:
        while group[t] != t:
            t = group[t]
        return t

    for i, a in enumerate(known):
        for b in known[i + 1 :]:
            if skeleton(a) == skeleton(b) or (abs(len(a) - len(b)) <= 1 and edit_distance(a, b) <= 1):
                group[top(b)] = top(a)
    out: dict[str, list[str]] = {}
    for t in known:
        out.setdefault(top(t), []).append(t)
    return [g for g in out.values() if len(g) > 1]


def abbreviations(described: DataFrame, support: int = 3, lift: float = 2.0) -> DataFrame:
    """(token, word, n, lift): words of descriptions that go with a name's token. described: name, description."""
    both = described.select("name", F.array_distinct(F.split(F.upper("name"), "_+")).alias("t"), F.array_distinct(F.regexp_extract_all(F.lower("description"), F.lit("([a-zçğıöşüâîû]{3,})"), F.lit(1))).alias("w"))
    total = both.count()
    token = both.select(F.explode("t").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("nt"))
    word = both.select(F.explode("w").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("nw"))
    cells = both.select(F.explode("t").alias("token"), "w").select("token", F.explode("w").alias("word")).groupBy("token", "word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= support)
    score = F.col("n") * F.lit(float(total)) / (F.col("nt") * F.col("nw"))
    return cells.join(token, "token").join(word, "word").select("token", "word", "n", score.alias("lift")).where(F.col("lift") >= lift)


def standard_name(name: str) -> str:
    """Upper case, single underscores, the window token last."""
    parts = [t.upper() for t in tokens(name)]
    windows = [t for t in parts if period_meaning(t)]
    return "_".join([t for t in parts if not period_meaning(t)] + windows)


def transfer(name: str, other: str, description: str) -> str | None:
    """The description of ``other`` for ``name``, if they differ in numbers only."""
    a, b = re.findall(r"[0-9]+", name), re.findall(r"[0-9]+", other)
    if re.sub(r"[0-9]+", "#", name) != re.sub(r"[0-9]+", "#", other) or len(a) != len(b):
        return None
    swap = dict(zip(b, a, strict=True))
    return re.sub(r"[0-9]+", lambda m: swap.get(m[0], m[0]), description)


def inconsistent(name: str, description: str) -> list[str]:
    """Numbers of a name's windows that its description doesn't mention."""
    said = set(re.findall(r"[0-9]+", description))
    return [t for t in tokens(name) if (m := period_meaning(t)) and str(m[1]) not in said]
