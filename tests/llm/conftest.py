from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    None, "", " \n\t ", "a", "İstanbul'da ΣΑΣ ﬁne — don't we'LL …", "x" * 5000, "<|endoftext|> a<|startoftext|>b",
    "dup line\ndup line\n\ndup line", "%%% ### $$$ !!!", "12 34 5.6", "日本語 テスト", "tab\tsep\x0bvt\x0cff\rcr", "word " * 300,
]


def prose(rng: random.Random, lang: str, n: int) -> str:
    parts = {"en": ["the", "th", "er", "ing", "on", "and", "ea"], "de": ["der", "sch", "ung", "ei", "ß", "ver", "ge"], "fr": ["le", "é", "eau", "ch", "que", "oi", "ai"]}[lang]
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) + rng.choice(["", "", ",", "."]) for _ in range(n))


@pytest.fixture(scope="session")
def rows() -> list[tuple]:
    """Odd texts, clean prose, exact and near copies, a repeated row, nulls in every column."""
    rng = random.Random(3)
    out = [(i, t, "en" if i % 2 else None, f"s{i % 3}" if i % 4 else None, None) for i, t in enumerate(ODD)]
    for i in range(100, 180):
        lang = ("en", "de", "fr")[i % 3]
        out.append((i, prose(rng, lang, rng.randint(8, 120)), lang, ("hot", "hot", "b", "c")[i % 4], 1))
    out += [(200 + i, out[20][1], "en", "hot", 1) for i in range(6)]
    out += [(210 + i, out[40][1] + " tail", "en", "b", 1) for i in range(2)]
    out += [out[30], (None, "no id here at all", "en", None, None), (None, None, None, None, None)]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    """With a column whose name clashes with the operators' own."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("id", "score", "fp", "size", "key", "word", "n_words"):
        df = df.withColumn(name, F.lit("clash"))
    return df.repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
