"""The queries of this subpackage: thin layers that apply an operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.llm import cascade, langid, lm, media, mixing, negatives, packing, quality, repeats, rolling, simhash, tokens, urlrules
from tabloom.llm.common import crc_mod, table

TOKENIZER = "word_bpe_49k.json"
URL_RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]
SAMPLE_ROWS = 1_000


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digest(media.store_text(table(spark, sf_dir, "documents")))


def op2_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlrules.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op3_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm.score(table(spark, sf_dir, "documents"), crc_mod(F.col("doc_id"), 7) != 2, every=True)
    return scored.select("doc_id", (~F.col("learned")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def judged(docs: DataFrame) -> DataFrame:
    """documents with the base counts and the verdict of the quality cascade."""
    text = cascade.text_of("text")
    counts = {"word_chars": cascade.word_chars(text), "n_symbols": cascade.n_symbols(text), "n_dup_lines": cascade.n_dup_lines(text)}

    def counted(df: DataFrame) -> DataFrame:
        prepared = cascade.with_repeats(cascade.with_words(df, text), "n_repeat_words")
        return prepared.select("doc_id", "text", cascade.HASHES, "n_repeat_words", F.size(cascade.HASHES).cast("long").alias("n_words"), *[c.alias(n) for n, c in counts.items()])

    rules = cascade.standard_rules(text, F.col("n_repeat_words"), F.col("n_symbols"), F.col("n_dup_lines"), F.col("word_chars"))
    order = cascade.order_rules(counted(cascade.sample_of(docs.select("doc_id", "text"), "doc_id", SAMPLE_ROWS)), rules)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    rejected = cascade.cascade(order).isNotNull()
    return counted(docs.select("doc_id", "text")).withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & ~rejected)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.tokenize_and_pack(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"), crc_mod(F.col("doc_id"), 3) != 1)
    scored = quality.score(docs, model)
    return scored.select("doc_id", (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs, crc_mod(F.col("doc_id"), 3) != 1)
    return langid.predict(docs, model).select("doc_id", (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, label)


def op12_rolling_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rolling.rolling_far(table(spark, sf_dir, "clicks"))


def op13_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_media, op2_url_rules, op3_pitman_yor, op4_quality_rules, op5_token_counts, op6_mixing, op7_simhash, op8_packing, op9_quality_classifier, op10_language, op11_hard_negatives, op12_rolling_median, op13_repeats)}


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_OP4 = rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS} AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM win) WHERE c > 1),
cov AS (SELECT doc_id, sum(least(5, coalesce(n - i, 5))) AS c FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS n FROM rep) GROUP BY 1),
f AS (SELECT doc_id, t, w, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS n_dup_lines,
CAST(coalesce(c, 0) AS BIGINT) AS n_repeat_words, len(string_split(t, chr(10))) AS lines FROM d LEFT JOIN cov USING (doc_id)),
r AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
10 * n_symbols > 2 * n_words OR 5 * (length(t) - length(regexp_replace(t, '\p{{Lu}}', '', 'g'))) > 2 * word_chars OR (n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 15 * n_words))
OR 5 * (length(t) - length(replace(t, '!', ''))) > n_words OR (lines >= 4 AND 2 * n_dup_lines > lines) OR 5 * len(list_filter(range(2, n_words + 1), lambda i: w[i] = w[i - 1])) > 2 * n_words AS rejected FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT rejected AS kept FROM r"""

_OP6 = rf"""WITH d AS (SELECT doc_id, source, CAST(len({_WORDS}) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS ss, [1, 2, 3][(row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1] AS w FROM d GROUP BY 1),
r AS (SELECT *, row_number() OVER o AS k, 3.0 * ss / w AS ratio, (sum(ss) OVER () - coalesce(sum(3 * ss) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / CAST(sum(w) OVER () - coalesce(sum(w) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS level FROM s WINDOW o AS (ORDER BY 3.0 * ss / w, source)),
l AS (SELECT level FROM r WHERE level <= ratio ORDER BY k LIMIT 1),
t AS (SELECT source, ss, least(3.0 * ss, l.level * w) AS target FROM s, l), p AS (SELECT *, CAST(floor(CASE WHEN ss > 0 THEN target / ss ELSE 0 END + 1e-12) AS BIGINT) AS whole FROM t),
o AS (SELECT d.*, p.ss, p.target, p.whole, CAST(round(p.target) AS BIGINT) - p.whole * p.ss AS rest, coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY substr(md5('17|' || d.doc_id || '|' || d.size), 1, 9), d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, ss AS source_size, target, CAST(whole * size + greatest(least(rest - before, size), 0) AS BIGINT) AS taken FROM o"""


_OP11 = """WITH v AS (SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_sum(list_transform(range(1, len(a.e) + 1), lambda i: a.e[i] * b.e[i])) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) AS INTEGER) AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score QUALIFY rank <= 10"""

_OP12 = """WITH c AS (SELECT click_id, kind, ts, CASE WHEN isfinite(value) THEN CAST(floor(100 * value + 0.5) AS BIGINT) END AS c, epoch_us(ts) // 900000000 AS cell
FROM clicks WHERE ts IS NOT NULL QUALIFY row_number() OVER (PARTITION BY click_id ORDER BY ts, kind NULLS FIRST, value NULLS FIRST) = 1),
b AS (SELECT kind, ts, c, unnest([cell, cell + 1]) AS cell FROM c),
w AS (SELECT a.click_id, a.kind, a.c, list_sort(list(b.c) FILTER (WHERE b.c IS NOT NULL)) AS l
FROM c a JOIN b ON a.kind IS NOT DISTINCT FROM b.kind AND a.cell = b.cell AND b.ts > a.ts - INTERVAL 15 MINUTE AND b.ts <= a.ts GROUP BY 1, 2, 3),
m AS (SELECT *, CAST(coalesce(len(l), 0) AS BIGINT) AS n, CASE WHEN len(l) > 0 THEN l[(len(l) + 1) // 2] + l[len(l) // 2 + 1] END AS median2 FROM w),
d AS (SELECT *, list_sort(list_transform(l, lambda x: abs(2 * x - median2))) AS e FROM m),
r AS (SELECT *, CASE WHEN n > 0 THEN e[(n + 1) // 2] + e[n // 2 + 1] END AS mad4 FROM d)
SELECT click_id, kind, n, median2, mad4, 2 * abs(2 * c - median2) > 2 * mad4 AS far FROM r"""


def oracle_sql() -> dict[str, str]:
    """Fingerprints, tokens, media and learnt models can't be had in SQL; the tests hold those against brute force."""
    return {"op4_quality_rules": _OP4, "op6_mixing": _OP6, "op11_hard_negatives": _OP11, "op12_rolling_median": _OP12}
