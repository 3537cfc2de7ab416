"""The corpus pipeline: five stages from raw documents to packed sequences.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and gives a
DataFrame; all but the last give the columns of documents. ``run`` writes every stage as
Parquet into the shared folder and reads it back as the next one's input.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.llm import cascade, langid, mixing, packing, queries, simhash
from tabloom.llm.common import crc_mod, materialise, prepare, quoted, table

#: Below this share of the best language a document counts as not identified.
LEAST_SHARE = 0.5
#: Near copies: words of a shingle, and the similarity of shingle sets from which on texts are copies.
WIDTH, SIMILARITY = 5, 0.8


def _apart(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs under column names c0, c1, ... that no stage uses itself, and the new name of each."""
    of = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    return docs.select(*[F.col(quoted(c)).alias(n) for c, n in of.items()]), of


def _back(rows: DataFrame, of: dict[str, str]) -> DataFrame:
    return rows.select(*[F.col(n).alias(c) for c, n in of.items()])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an identified language go; lang stays as it was given."""
    prepare(spark)
    model = langid.fit(docs, crc_mod(F.col("doc_id"), 3) != 1)
    rows, of = _apart(docs)
    found = langid.predict(rows, model, of["doc_id"], of["text"], keep=tuple(of.values()), out=("found", "share"))
    return _back(found.where((F.col("found") != langid.UNKNOWN) & (F.col("share") >= LEAST_SHARE)), of)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a rule rejects go; the rules run as a cascade, the cheap and sharp ones first."""
    rows, of = _apart(docs)
    text = cascade.text_of(of["text"])
    rules = cascade.standard_rules(text, F.col("repeats"))
    sample = cascade.with_repeats(cascade.with_words(cascade.sample_of(rows, of["doc_id"], queries.SAMPLE_ROWS), text), "repeats")
    order = cascade.order_rules(sample, rules)
    dear = [r for r in order if r.name == "repeats"]
    passed = cascade.with_words(rows, text).where(cascade.cascade([r for r in order if r.name != "repeats"]).isNull())
    return _back(cascade.with_repeats(passed, "repeats").where(cascade.cascade(dear).isNull()), of)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8) the document with the least id stays.

    A document is told from others by id and text: different texts under one id, or without
    one, are documents of their own, and rows that agree in both are copies. An id comes
    before none; among equal ids the least digest of the text does.
    """
    rows, of = _apart(docs)
    number = F.col(of["doc_id"]).cast("decimal(20,0)") + F.lit(str(1 << 63)).cast("decimal(20,0)")
    digest = F.md5(F.coalesce(F.concat(F.lit("t"), F.col(of["text"])), F.lit("")))
    rows = rows.withColumn("key", F.concat(F.coalesce(F.lpad(number.cast("decimal(20,0)").cast("string"), 20, "0"), F.lit("~")), F.lit(" "), digest))
    groups = simhash.near_duplicates(rows, "key", of["text"], width=WIDTH, similarity=SIMILARITY)
    stay = groups.where(F.col("key") == F.col("component_id")).select("key").distinct()
    return _back(rows.join(stay, "key", "left_semi").dropDuplicates(["key"]), of)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated as the mix takes them; those that it takes no word of leave."""
    return mixing.mixed_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.tokenize_and_pack(docs, public_tokenizers.path(queries.TOKENIZER))


STAGES = [("language", language), ("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("mixing", mixing_stage), ("packing", packing_stage)]

#: Fingerprints, tokens and models can't be had in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
