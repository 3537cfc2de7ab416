"""Language and quality scores against plain Python that shares no code with the operators."""

from __future__ import annotations

import math
import unicodedata
from collections import Counter, defaultdict

import numpy as np
import zstandard
from pyspark.sql import functions as F

from tabloom.llm import langid, quality

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def letters(text):
    out, word = [], ""
    for c in (text or "").lower():
        if unicodedata.category(c).startswith("L"):
            word += c
        elif word:
            out.append(word)
            word = ""
    return [*out, word] if word else out


def brute_language(train, texts):
    """Predictions and scores: known words by add-half log frequency, others by the mean of their longest known n-grams."""
    langs = sorted({lang for _, lang in train})
    tables = []
    for n in range(6):  # 0: words
        counts = {lang: Counter() for lang in langs}
        for text, lang in train:
            for w in letters(text):
                marked = f" {w} " if n > 1 else w
                counts[lang].update([w] if n == 0 else [marked[i : i + n] for i in range(len(marked) - n + 1)])
        size = len(set().union(*counts.values()))
        tables.append({k: [math.log((counts[lang][k] + 0.5) / (counts[lang].total() + 0.5 * (size + 1))) for lang in langs] for lang in langs for k in counts[lang]})
    prior = [math.log((sum(x == lang for _, x in train) + 1) / (len(train) + len(langs))) for lang in langs]
    out = []
    for text in texts:
        if not letters(text):
            out.append(("und", 0.0))
            continue
        total = list(prior)
        for w in letters(text):
            if w in tables[0]:
                row = tables[0][w]
                found = [row]
            else:
                for n in range(min(5, len(w) + 2), 0, -1):
                    marked = f" {w} " if n > 1 else w
                    found = [tables[n][g] for g in (marked[i : i + n] for i in range(len(marked) - n + 1)) if g in tables[n]]
                    if found:
                        break
            # rows count from their largest entry
            for i in range(len(langs)):
                total[i] += sum(r[i] - max(r) for r in found) / max(1, len(found))
        best = max(range(len(langs)), key=lambda i: (total[i], -i))
        out.append((langs[best], 1 / sum(math.exp(t - total[best]) for t in total)))
    return out


def test_language_against_brute_force(docs, rows):
    train = [(r[1], r[2]) for r in {(r[0], r[1]): r for r in rows if r[0] is not None and r[0] % 2 == 0 and r[1] is not None and r[2] is not None}.values()]
    model = langid.fit(docs, F.col("doc_id") % 2 == 0)
    got = Counter((r.doc_id, r.lang_pred, round(r.score, 4)) for r in langid.predict(docs, model).collect())
    want = Counter((r[0], lang, round(score, 4)) for r, (lang, score) in zip(rows, brute_language(train, [r[1] for r in rows]), strict=True))
    assert got == want


def test_number_forms_are_no_letters(spark, docs):
    model = langid.fit(docs, F.lit(True))
    texts = ["½ ² Ⅷ ①", "٣ ४ _ ‿", "ª", "ʰ", "a½"]
    got = [r.lang_pred for r in langid.predict(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), model).orderBy("doc_id").collect()]
    assert got[:2] == ["und", "und"] and "und" not in got[2:]


def test_every_language_teaches(spark):
    """120 languages, one of which has one very long text only; and 3,000 equal rows without an id."""
    rows = [(i * 10 + k, f"{'abcdefghij'[i // 12]}{'klmnopqrstuv'[i % 12]}z " * 30, f"l{i:03}", None, 0) for i in range(119) for k in range(3)]
    rows += [(5000, "xqx wqw " * 12_000, "l119", None, 0)] + [(None, "hot words here", "l000", None, 0)] * 3000
    df = spark.createDataFrame(rows, SCHEMA)
    chosen = langid.sample(df, F.lit(True), "doc_id", "text", "lang", 100, 60_000)
    assert chosen.count() == 119 * 3 + 2
    assert langid.sample(df, F.lit(True), "doc_id", "text", "lang", 2, 60_000).groupBy("lang").count().agg(F.max("count")).first()[0] == 2
    assert langid.sample(df, F.lit(True), "doc_id", "text", "lang", 100, 240).count() == 119 * 2 + 1
    model = langid.fit(df, F.lit(True), per_lang=100)
    assert len(model.languages) == 120
    got = langid.predict(df.where("doc_id IS NOT NULL"), model, keep=("lang",)).collect()
    assert all(r.lang_pred == r.lang for r in got)


def brute_quality(train, halves, texts, dict_bytes):
    """Two dictionaries from the first halves, then logistic regression by plain gradient steps until nothing moves."""
    level = 3
    sides = []
    for label in (1, 0):
        mine = [t for (t, q), h in zip(train, halves, strict=True) if q == label and h == 0 and t]
        try:
            raw = zstandard.train_dictionary(dict_bytes, mine, level=level).as_bytes()
        except zstandard.ZstdError:
            raw = b"".join(mine)[-dict_bytes:]
        sides.append(raw)

    def features(t):
        a, b = (len(zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(raw), write_checksum=False, write_content_size=False, write_dict_id=False).compress(t)) for raw in sides)
        d, s = (a - b) / (a + b), math.log((a + b + 16) / (2 * (len(t) + 16)))
        return [1.0, 10 * d, 100 * d * abs(d), s, s * s, 10 * d * s, math.log(len(t) + 16) / 10]

    own = [(features(t), q) for (t, q), h in zip(train, halves, strict=True) if h == 1]
    x, y = np.array([f for f, _ in own]), np.array([q for _, q in own], float)
    share = sum(q for _, q in train) / len(train)
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    ridge = np.array([1e-9] + [1e-2] * 6)
    w = np.zeros(7)
    for _ in range(200):  # damped Newton on the penalised likelihood
        p = 1 / (1 + np.exp(-x @ w))
        gradient = x.T @ (weight * (y - p)) - ridge * w
        hessian = x.T @ (x * (weight * p * (1 - p))[:, None]) + np.diag(ridge)
        w = w + 0.7 * np.linalg.solve(hessian, gradient)
    return [1 / (1 + math.exp(-float(np.dot(features(t), w)))) for t in texts]


def test_quality_against_brute_force(spark):
    import random

    rng = random.Random(21)
    good, bad = [f"river{i} stone" for i in range(60)], [f"click{i}!! buy" for i in range(60)]
    rows = []
    for i in range(240):
        q = i % 2
        own = [rng.choice(good if (rng.random() < 0.8) == bool(q) else bad) for _ in range(rng.randint(3, 60))]
        rows.append((i, " ".join(own) if i != 200 else " ".join(own) * 400, q))  # one of over 60,000 characters
    df = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(900, ""), (901, None)], "doc_id long, text string")
    assert max(len(t) for _, t, _ in rows) > 60_000
    labels = spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id long, quality int")
    dict_bytes = 8 << 10
    got = {r.doc_id: r.score for r in quality.score(df, quality.fit(df, labels, F.col("doc_id") % 3 != 1, dict_bytes=dict_bytes)).collect()}
    half = {r.doc_id: r.h for r in df.select("doc_id", F.pmod(F.xxhash64(F.col("doc_id").alias("id"), F.lit(7)), F.lit(2)).alias("h")).collect()}
    teach = sorted((half[i], t.encode(), q) for i, t, q in rows if i % 3 != 1)
    want = brute_quality([(t, q) for _, t, q in teach], [h for h, _, _ in teach], [t.encode() for _, t, _ in rows] + [b"", b""], dict_bytes)
    for i, w in zip([*range(240), 900, 901], want, strict=True):
        assert abs(got[i] - w) < 1e-6, i
    held = defaultdict(list)
    for i, _, q in rows:
        if i % 3 == 1:
            held[q].append(got[i])
    assert np.mean(held[1]) > np.mean(held[0]) + 0.3
