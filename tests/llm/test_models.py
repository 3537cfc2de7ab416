"""SimHash, components, language, quality, language model, URL rules, pipeline."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tabloom.llm import langid, lm, queries, quality, simhash, urlrules
from tabloom.llm.common import crc_mod, table
from tabloom.llm.components import components


def partition(pairs, nodes):
    root = {n: n for n in nodes}

    def top(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in pairs:
        x, y = top(a), top(b)
        root[max(x, y)] = min(x, y)
    return {n: top(n) for n in nodes}


def test_components(spark):
    rng = random.Random(5)
    pairs = [(i, i + 1) for i in range(0, 60)] + [(rng.randrange(100, 400), rng.randrange(100, 400)) for _ in range(150)] + [(500, x) for x in range(501, 540)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = partition(pairs, {n for p in pairs if p[0] != p[1] for n in p})
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_fingerprint(text):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_near_duplicates(docs, rows):
    prints = [brute_fingerprint(r[1]) for r in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3]
    group = partition(links, range(len(rows)))
    least = defaultdict(list)
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[group[i]].append(r[0])
    want = Counter((r[0], prints[i], min(least[group[i]], default=None)) for i, r in enumerate(rows))
    got = Counter((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert got == want


@pytest.mark.parametrize("max_bucket", [2_000, 15])
def test_links_lose_nothing(spark, max_bucket):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, size=30, dtype=np.uint64)
    found = base.tolist()
    for b in base[:10].tolist():
        for _ in range(40):
            x = b
            for i in rng.integers(0, 64, rng.integers(1, 6)).tolist():
                x ^= 1 << i
            found.append(x)
    fps = np.unique(np.array(found, np.uint64))
    want = partition([(int(fps[i]), int(fps[j])) for i in range(len(fps)) for j in np.flatnonzero(np.bitwise_count(fps[:i] ^ fps[i]) <= 3)], [int(x) for x in fps])
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    got = simhash.links(df, 3, max_bucket).collect()
    mask = (1 << 64) - 1
    assert all(((r.a & mask) ^ (r.b & mask)).bit_count() <= 3 for r in got)
    assert partition([(r.a & mask, r.b & mask) for r in got], [int(x) for x in fps]) == want


def test_pivots_never_discard_a_pair():
    rng = np.random.default_rng(6)
    fps = rng.integers(0, 2**63, size=200, dtype=np.uint64)
    near = fps ^ (np.uint64(1) << rng.integers(0, 64, 200).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 200).astype(np.uint64))
    far = [np.abs(np.bitwise_count(a ^ simhash._PIVOTS).astype(int) - np.bitwise_count(b ^ simhash._PIVOTS).astype(int)).max() for a, b in zip(fps, near, strict=True)]
    assert max(far) <= 3


def test_language(spark, docs):
    model = langid.fit(docs, F.col("doc_id") % 2 == 0)
    assert model.languages == ["de", "en", "fr"]
    got = {r.doc_id: r for r in langid.predict(docs, model, keep=("lang",)).collect() if r.doc_id is not None}
    clean = [r for i, r in got.items() if 100 <= i < 180]
    assert sum(r.lang == r.lang_pred for r in clean) >= 0.95 * len(clean)
    assert all(0 <= r.score <= 1 for r in got.values())
    for i in (0, 1, 2, 8, 9):  # null, empty, white space, marks, digits
        assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
    assert got[10].lang_pred in model.languages  # letters, though none was ever seen


def test_language_without_training(docs, empty):
    model = langid.fit(empty, F.lit(True))
    assert {r.lang_pred for r in langid.predict(docs, model).collect()} == {"und"}
    assert langid.predict(empty, model).count() == 0


def test_language_memo_limit(docs, monkeypatch):
    model = langid.fit(docs, F.lit(True))
    want = sorted((str(r.doc_id), r.lang_pred, round(r.score, 6)) for r in langid.predict(docs, model).collect())
    texts = [r.text for r in docs.select("text").collect()]
    by_hand = []
    for t in texts:
        parts = [p for w in (t or "").encode().translate(langid._CLEAN).split() for p in langid._LETTERS.findall(w.decode().lower())]
        if not parts:
            by_hand.append("und")
            continue
        by_hand.append(model.languages[int(np.argmax(model.prior + sum(model.rows([p])[0] for p in parts)))])
    assert Counter(w[1] for w in want) == Counter(by_hand)


@pytest.mark.parametrize("cells", [1 << 20, 50])
def test_language_tables_hold_counts_only(monkeypatch, cells):
    """150 languages: sparse rows equal the smoothed logs of all languages, looked up at once or in steps, and hold a value a count."""
    monkeypatch.setattr(langid, "CELLS", cells)
    rng = random.Random(4)
    bags = {f"l{i:03}": Counter({"".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6))): rng.randint(1, 9) for _ in range(i % 40)}) for i in range(150)}
    model = langid.build(bags, dict.fromkeys(bags, 2))
    assert len(model.word_table.values) == sum(map(len, bags.values()))
    known = sorted(set().union(*bags.values()))
    total = np.array([sum(b.values()) for b in bags.values()])
    whole = np.log((np.array([[b[w] for b in bags.values()] for w in known]) + 0.5) / (total + 0.5 * (len(known) + 1)))
    assert np.allclose(model.rows(known), whole - whole.max(axis=1, keepdims=True), atol=1e-5)
    unseen = "bcdabc" * 60
    n, grams = next((n, g) for n in range(5, 0, -1) if (g := [unseen_gram for i in range(len(langid._edged(unseen, n)) - n + 1) if (unseen_gram := langid._edged(unseen, n)[i : i + n]) in model.grams[n - 1]]))
    own = [Counter(e[i : i + n] for w, t in b.items() for _ in range(t) for e in [langid._edged(w, n)] for i in range(len(e) - n + 1)) for b in bags.values()]
    total = np.array([sum(c.values()) for c in own])
    rows = np.array([np.log((np.array([c[g] for c in own]) + 0.5) / (total + 0.5 * (len(model.grams[n - 1]) + 1))) for g in grams])
    assert np.allclose(model.rows([unseen])[0], (rows - rows.max(axis=1, keepdims=True)).mean(axis=0), atol=1e-5)


def test_backoff_prefers_words_then_long_grams():
    model = langid.learn([("sun sun moon", "a"), ("mond mond sonne", "b")])
    assert np.argmax(model.rows(["sun"])[0]) == 0
    assert np.argmax(model.rows(["monde"])[0]) == 1  # unseen: its longest n-grams are of b
    assert np.allclose(model.rows(["§"])[0], 0)


def test_quality_learns(spark, small):
    docs, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    model = quality.fit(docs, labels, crc_mod(F.col("doc_id"), 3) != 1)
    scored = quality.score(docs, model).join(labels, "doc_id").where(crc_mod(F.col("doc_id"), 3) == 1).collect()
    assert sum((r.score >= 0.5) == (r.quality == 1) for r in scored) >= 0.9 * len(scored)


def test_quality_edges(spark, docs, empty):
    one = spark.createDataFrame([(100, 1), (101, 1), (102, None), (103, 1)], "doc_id long, quality int")
    model = quality.fit(docs, one, F.lit(True))
    assert model.constant == 1.0
    none = quality.fit(docs, one.where("false"), F.lit(True))
    assert {r.score for r in quality.score(docs, none).collect()} == {0.5}
    assert quality.score(empty, none).count() == 0
    many = spark.createDataFrame([(i, i % 2) for i in range(100, 180)], "doc_id long, quality int")
    got = quality.score(docs, quality.fit(docs, many, F.lit(True))).collect()
    assert all(0 <= r.score <= 1 and math.isfinite(r.score) for r in got)


def test_language_model(spark, docs, rows):
    got = lm.score(docs, F.col("doc_id") % 3 != 0).collect()
    counts: Counter = Counter()
    split = [[*(r[1] or "").encode().lower().split(), None] for r in rows]
    for r, w in zip(rows, split, strict=True):
        if r[0] is not None and r[0] % 3 != 0:
            counts.update(w)
    total, vocabulary = sum(counts.values()), len(counts)
    want = Counter((r[0], len(w), sum(counts[x] > 0 for x in w), total, round(sum(math.log10((counts[x] + 1) / (total + vocabulary + 1)) for x in w), 6)) for r, w in zip(rows, split, strict=True))
    assert Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 for r in got)
    assert sum(r.score for r in got if not r.learned) > sum(r.base_score for r in got if not r.learned)


def test_language_model_tail(spark, docs, monkeypatch):
    """With next to no head, counts and base scores stay the same: the head only places work."""
    want = sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 6)) for r in lm.score(docs, F.col("doc_id") % 3 != 0).collect())
    monkeypatch.setattr(lm, "_head_words", lambda rows, n: np.concatenate(([lm._END], np.arange(1, 4, dtype=np.uint64))))
    got = sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 6)) for r in lm.score(docs, F.col("doc_id") % 3 != 0).collect())
    assert got == want


def test_language_model_edges(spark, docs, empty):
    got = lm.score(docs, F.lit(False)).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and r.base_score == 0 and abs(r.score) < 1e-9 for r in got)
    assert lm.score(empty, F.lit(True)).count() == 0


URLS = [
    None, "", "no scheme", "http://Example.COM/en/a", "https://www.example.com/en/x?q=1", "http://a.example.com/en/", "http://notexample.com/en/", "ftp://x.net/es/", "http://net/fr/1",
    "http://x.net/fr", "http://x.org/de/5.html", "x://y.org#f/en", "http://a.b.net?x=/es/", "http://h/p://q", "http://x.net/es/é?z", "HTTP://U.NET/ES/",
]


def brute_url(u):
    if u is None or "://" not in u:
        return "", "", None, None
    rest = u.split("://", 1)[1]
    end = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
    rest = rest[end:]
    path = rest[: min((rest.find(c) for c in "?#" if c in rest), default=len(rest))]
    best = None
    for rule, verdict in queries.URL_RULES:
        name, _, p = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[0])):
            best = rule, verdict
    return (host, path, *(best or (None, None)))


def test_url_rules(spark):
    rng = random.Random(2)
    urls = URLS + [f"http://{rng.choice(['a', 'b', 'spam'])}.example.{rng.choice(['com', 'net', 'org'])}/{rng.choice(['en', 'de', 'fr'])}/{rng.randrange(99)}" for _ in range(400)]
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, verdict string")
    got = {r.page_id: r for r in urlrules.judge(df, queries.URL_RULES).collect()}
    assert len(got) == len(urls)
    for i, u in enumerate(urls):
        host, path, rule, verdict = brute_url(u)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule), u
        assert got[i].verdict == verdict if verdict else got[i].verdict in ("allow", "block")
    mined = [r for r in got.values() if r.mined]
    assert mined and all(set(r.mined.split(" ")) <= set(tokens_of(r)) for r in mined)


def tokens_of(r):
    import re

    return [f"h:{re.sub('[0-9]+', '0', x)}" for x in r.host.split(".")] + [f"p:{re.sub('[0-9]+', '0', x)}" for x in r.path.split("/") if x]


def test_mined_rules_against_brute_force(spark):
    rng = random.Random(4)
    rows = [(sorted({rng.choice("abcd"), rng.choice("abcd"), "e"}), rng.choice(["allow", "block", "block"])) for _ in range(200)]
    got = urlrules.mine(spark.createDataFrame(rows, "tokens array<string>, verdict string"), 0.05, 0.55, 2, 100)
    for tokens, label, confidence, support in got:
        both = sum(set(tokens) <= set(t) and v == label for t, v in rows)
        assert abs(confidence - both / sum(set(tokens) <= set(t) for t, _ in rows)) < 1e-9 and abs(support - both / len(rows)) < 1e-9
        assert confidence >= 0.55 and support >= 0.05 and "e" not in tokens
    singles = {t for t in "abcd" if (n := sum(t in x for x, _ in rows)) and any(sum(t in x and v == lab for x, v in rows) / n >= 0.55 and sum(t in x and v == lab for x, v in rows) >= 10 for lab in ("allow", "block"))}
    assert {t[0] for t, *_ in got if len(t) == 1} == singles


def test_url_rules_without_labels(spark):
    df = spark.createDataFrame([(1, "http://x.org/"), (2, None)], "page_id long, url string")
    assert {r.verdict for r in urlrules.judge(df, []).collect()} == {"allow"}
    assert urlrules.judge(df.where("false"), queries.URL_RULES).count() == 0


def test_queries_run(spark, small):
    for name, query in queries.queries().items():
        df = query(spark, small)
        source = "pages" if name.startswith("op2") else "documents"
        n = table(spark, small, source).count()
        assert df.count() >= n if name.startswith("op8") else df.count() == n, name


def test_sql_twins(spark, small):
    import oracle

    con = oracle.connect(small)
    for name, sql in queries.oracle_sql().items():
        assert not oracle.differences(queries.queries()[name](spark, small), con, sql), name


def near_copies_against_shingle_sets(texts, kept):
    """No two kept texts are near copies, and what left is a copy, over copies, of a kept text with a lesser id."""
    sets = {i: set(simhash.shingle_hashes((t or "").encode(), 5).tolist()) for i, t in texts.items()}
    ids, links = sorted(sets), []
    for x, i in enumerate(ids):
        for j in ids[:x]:
            similarity = len(sets[i] & sets[j]) / max(1, len(sets[i] | sets[j])) if sets[i] or sets[j] else 1.0
            assert similarity < 0.83 or not (i in kept and j in kept)
            if similarity > 0.7:
                links.append((i, j))
    group = partition(links, ids)
    assert all(min(k for k in kept if group[k] == group[i]) < i for i in set(ids) - kept)


def test_pipeline(spark, small):
    """Every stage against what its operator says by itself, near copies against their shingle sets."""
    import corpus_pipeline

    docs = table(spark, small, "documents")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, small)
        assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        out = out.cache()
        kept[name] = {r.doc_id for r in out.select("doc_id").collect()}
        if name == "near_duplicates":
            near_copies_against_shingle_sets({r.doc_id: r.text for r in docs.collect()}, kept[name])
        if name == "quality_rules":
            assert kept[name] == {r.doc_id for r in queries.judged(docs).where("kept").collect()}
        docs = out
    labels = {r.doc_id: r.quality for r in table(spark, small, "labels").collect()}
    assert all(labels.get(i) != 0 for i in kept["quality_rules"])
    assert corpus_pipeline.STAGES[-1][1](spark, docs, small).select("sequence_id").distinct().count() > 0
    assert zlib.crc32(b"") == 0


def test_pipeline_stages_on_odd_rows(spark, docs, rows, empty, small):
    """Nulls in every column, repeated rows, empty tables: no stage breaks, and clean documents stay."""
    import corpus_pipeline

    for start in (docs.withColumn("lang_pred", F.lit("clash")), empty):
        now = start
        for name, stage in corpus_pipeline.STAGES:
            now = stage(spark, now, small).cache()
            ids = [r.doc_id for r in now.select("doc_id").collect()]
            if name == "near_duplicates":
                assert len(set(ids) - {None}) == len([i for i in ids if i is not None])
        assert (now.count() == 0) == (start is empty)
