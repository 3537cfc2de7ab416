"""Removal of repeated strings against the definition."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from tabloom.llm import queries, repeats

SCHEMA = "doc_id long, text string, num string, p string, key string, runs string"


def naive(texts: list[bytes], length: int = repeats.LENGTH) -> list[tuple]:
    """(n_bytes, n_removed, spans, kept) of each text."""
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        turns = np.flatnonzero(np.diff(np.concatenate(([False], gone)).astype(int)))
        spans = tuple(zip(turns[::2].tolist(), turns[1::2].tolist(), strict=True))
        out.append((len(t), int(gone.sum()), spans, bytes(b for b, g in zip(t, gone, strict=False) if not g)))
    return out


def check(spark, texts: list[str | None], parts: int = 3) -> None:
    rows = [(i % 50, t, "c", "c", "c", "c") for i, t in enumerate(texts)]
    got = Counter((r.n_bytes, r.n_removed, tuple(tuple(s) for s in r.spans), bytes(r.kept)) for r in repeats.remove_repeats(spark.createDataFrame(rows, SCHEMA).repartition(parts)).collect())
    assert got == Counter(naive([(t or "").encode() for t in texts]))


def words(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus() -> list[str | None]:
    """Passages just below, at and above the length; runs; near copies; copies; texts that end in a passage."""
    rng = random.Random(11)
    passage = words(rng, 200)
    out: list[str | None] = [None, None, "", "short", "short", "x" * 199, "x" * 200, "x" * 900, "ab" * 400, "abc" * 70, "y" * 199 + "z"]
    for n in (198, 199, 200, 201, 230, 300, 500):
        at = rng.randrange(300)
        piece = passage[at : at + n]
        out += [words(rng, 60) + piece + words(rng, 50), piece + words(rng, 40), words(rng, 30) + piece, piece]
    base = words(rng, 400)
    for i in range(12):
        near = base.split(" ")
        for _ in range(i):
            near[rng.randrange(len(near))] = words(rng, 1)
        out.append(" ".join(near))
    out += [base, base, base[:150] + base, "é" * 120, "é" * 99 + "q" + "é" * 99, words(rng, 500)]
    return out


def test_definition(spark, corpus):
    check(spark, corpus)


def test_wide_classes(spark, corpus, monkeypatch):
    """Classes of anchors too wide for a task go as rows; small runs of work at a time."""
    monkeypatch.setattr(repeats, "CLASS", 3)
    monkeypatch.setattr(repeats, "FRAGMENTS", 2)
    check(spark, corpus, 7)


def test_wide_classes_by_blocks(spark, monkeypatch):
    """Surroundings that share an anchor only give a row a block of offsets, not a row a string; repeats across shares are found."""
    rng = random.Random(5)
    near = [bytes(rng.choices(b"abcdefgh", k=repeats.LENGTH - repeats.WIDTH)) + b"+" * repeats.WIDTH + bytes(rng.choices(b"abcdefgh", k=repeats.LENGTH - repeats.WIDTH)) for _ in range(50)]
    ahead = repeats.LENGTH - repeats.WIDTH
    rows = pa.table({"core": [1] * 50, "share": [0] * 50, "shares": [2] * 50, "num": list(range(50)), "p": pa.array([ahead] * 50, pa.int32()), "ahead": pa.array([ahead] * 50, pa.int16()), "piece": near})
    made = sum(b.num_rows for b in repeats._edges(rows))
    assert 0 < made <= 50 * -(-(ahead + 1) // repeats.BLOCK)
    monkeypatch.setattr(repeats, "CLASS", 2)
    passage = words(rng, 12)
    texts = [words(rng, 45) + passage + words(rng, 45) for _ in range(40)]
    for i in range(12):  # at every distance from the passage, of lengths about the limit
        t, at = texts[i], rng.randrange(40, 160)
        texts.append(words(rng, 20) + t[at : at + 196 + i] + words(rng, 20))
    check(spark, texts, 5)


def test_long_texts_in_pieces(spark, corpus, monkeypatch):
    monkeypatch.setattr(repeats, "PIECE", 700)
    rng = random.Random(4)
    long = words(rng, 2_000)
    check(spark, [*corpus, long, words(rng, 900) + long[1_000:4_000] + words(rng, 20), long[5_000:5_199] + "!" + long[7_000:7_200]])


def test_shared_passage(spark):
    """A passage in many texts, with another before and after it in each."""
    rng = random.Random(9)
    passage = words(rng, 70)
    check(spark, [words(rng, rng.randint(0, 40)) + passage[i % 3 :] + words(rng, rng.randint(0, 40)) for i in range(120)])


def test_random_bytes_of_two_letters(spark):
    """Many accidental matches of almost the length."""
    rng = random.Random(2)
    for _ in range(3):
        motif = "".join(rng.choice("ab") for _ in range(260))
        texts = []
        for _ in range(25):
            t = list(motif * rng.randint(1, 3))
            for _ in range(rng.randint(0, 4)):
                t[rng.randrange(len(t))] = rng.choice("ab")
            cut = rng.randrange(60)
            texts.append("".join(t)[cut:])
        check(spark, texts)


def test_empty_table(spark):
    assert repeats.remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query(spark, small):
    """Over the whole small table, by hashes of all its strings."""
    docs = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()}
    want = dict(zip(docs, naive(list(docs.values())), strict=True))
    got = {r.doc_id: tuple(r)[1:] for r in queries.op13_repeats(spark, small).collect()}
    assert got == {i: (n, gone, len(spans), hashlib.sha256(kept).hexdigest()) for i, (n, gone, spans, kept) in want.items()}
    assert sum(g[1] for g in got.values()) > 0
