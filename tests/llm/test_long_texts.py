"""Very long texts, odd pictures, equal rows in the packing order."""

from __future__ import annotations

import hashlib
import io
import random
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tabloom.llm import media, packing, tokens

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(TOKENIZER)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("abzAZs'!.,;<|>_-#019 \n"), max_size=60), st.integers(1, 9))
def test_long_fragments_keep_ids(text, limit):
    from tokenizers import Tokenizer

    library = test_long_fragments_keep_ids.library = getattr(test_long_fragments_keep_ids, "library", None) or Tokenizer.from_file(TOKENIZER)
    own = tokens.encoder(TOKENIZER)
    cut = [u for p in tokens.parts(text.encode(), 3 * limit) for u in tokens.units(p, limit)]
    own.learn(set(cut))
    assert np.frombuffer(b"".join(own.ids[u] for u in cut), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_parts_are_the_text():
    text = b" ".join(b"w%d" % i for i in range(5000))
    got = list(tokens.parts(text, 100))
    assert b"".join(got) == text and max(map(len, got)) < 110 and list(tokens.parts(None)) == list(tokens.parts(b"")) == []


def long_texts():
    rng = random.Random(4)
    words = [f"word{i}" for i in range(3000)]
    return [" ".join(rng.choice(words) for _ in range(700_000)), "ab,cd;ef!" * 300_000, "x y" * 5, ""]


def test_long_texts_count_and_pack(spark, library):
    texts = long_texts()
    assert len(texts[0]) > 2 * tokens.PART_BYTES and len(texts[1]) > tokens.PART_BYTES
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    ids = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert {r.doc_id: r.n_tokens for r in tokens.token_counts(df, TOKENIZER).collect()} == {i: len(x) for i, x in enumerate(ids)}
    want = Counter()
    for i, x in enumerate(ids):
        x = [*x, 1]
        for k in range(0, len(x), 4096):
            part = x[k : k + 4096]
            want[i, k // 4096, k, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))] += 1
    assert Counter(tuple(r) for r in packing.pieces(df, TOKENIZER).collect()) == want


def test_equal_rows_pack_in_several_ranges(spark):
    """2,000 rows without an id and of one length, in 4 ranges: each sequence is full and gapless."""
    df = spark.createDataFrame([(None, 0, 10)] * 2000 + [(i, 0, 7) for i in range(100)], "doc_id long, piece int, length long")
    got = packing.pack(df.repartition(5), 64).collect()
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for spans in by.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 64
    assert len(got) == 2100 and len(by) <= (20_000 + 700) / 64 * 1.1 + 1
    from pyspark.sql import functions as F

    salted = df.repartition(5).withColumn("s", F.xxhash64(F.monotonically_increasing_id()))
    sizes = [r["count"] for r in salted.repartitionByRange(4, "length", "doc_id", "s").groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 1000


def test_odd_pictures_never_stop_a_job(spark):
    bad = [b"P2 2 1 255\n7 99999999999999999999999", b"P3 1 1 255 1 2 300", b"P2 1 1 15 16", b"P1 2 1 2 0", b"P2 99999999999 1 255 1", b"P5 1 1 70000 x", b"BM" + bytes(60), b"P2 1 1 255 -5"]
    got = media.media_features(spark.createDataFrame(list(enumerate(bad)), "id int, m binary"), "id", "m").collect()
    assert len(got) == len(bad) and all(r.dhash is None and r.tile is None for r in got)


def test_samples_are_scaled_by_the_largest_value(spark):
    rng = np.random.default_rng(3)
    picture = rng.integers(0, 16, (32, 32))
    text = b"P2 32 32 15 " + b" ".join(b"%d" % x for x in picture.ravel())
    wide = rng.integers(0, 65536, (32, 32))
    deep = b"P5 32 32 65535\n" + wide.astype(">u2").tobytes()
    rows = {r.id: np.load(io.BytesIO(bytes(r.tile))) for r in media.media_features(spark.createDataFrame([(1, text), (2, deep)], "id int, m binary"), "id", "m").collect()}
    assert (rows[1] == picture * 17).all()
    assert (rows[2] == np.rint(wide / 257)).all() and len(np.unique(rows[2])) > 100


def test_null_media_have_null_digests(spark):
    df = spark.createDataFrame([(1, 3, None), (2, 3, media.store_payload(media.payload(b"abc"), "netpbm"))], "doc_id long, n_bytes long, media binary")
    got = {r.doc_id: r for r in media.media_digest(df).collect()}
    assert got[1].media_sha256 is None and got[1].payload_bytes is None and got[2].payload_bytes == 64


def test_undecodable_media_stop_no_digest(spark):
    """Bytes that are no picture, a cut raster, an empty value: the stored form's own figures, nulls for the rest."""
    good = media.store_payload(media.payload(b"abc"), "netpbm")
    df = spark.createDataFrame([(1, 3, b"no picture"), (2, 3, good[:-1]), (3, 3, b""), (4, 3, b"P5 9 9 70000 "), (5, 3, good)], "doc_id long, n_bytes long, media binary")
    got = {r.doc_id: r for r in media.media_digest(df).collect()}
    for i, data in ((1, b"no picture"), (2, good[:-1]), (3, b""), (4, b"P5 9 9 70000 ")):
        assert tuple(got[i])[1:] == (3, None, None, None, len(data), hashlib.sha256(data).hexdigest(), None)
    assert got[5].payload_bytes == 64 and got[5].feature


@pytest.mark.parametrize("shape", [(1, 1), (1, 64), (70, 64), (5_000, 64), (3, 9_000), (333, 77)])
@pytest.mark.parametrize("band", [1 << 18, 100])
def test_resize_in_bands(monkeypatch, shape, band):
    """Whatever is summed at once, the integral image of the whole picture gives the same means."""
    monkeypatch.setattr(media, "BAND", band)
    picture = np.random.default_rng(2).integers(0, 65_536, shape).astype(np.uint16)
    whole = np.zeros((shape[0] + 1, shape[1] + 1), np.int64)
    whole[1:, 1:] = picture.astype(np.int64).cumsum(0).cumsum(1)
    for got, (height, width) in zip(media.area_resizes(picture, [(8, 9), (32, 32)]), [(8, 9), (32, 32)], strict=True):
        y, x = (np.arange(p + 1) * n / p for n, p in zip(shape, (height, width), strict=True))
        read = np.apply_along_axis(lambda c: np.interp(y, np.arange(shape[0] + 1), c), 0, whole)
        read = np.apply_along_axis(lambda c: np.interp(x, np.arange(shape[1] + 1), c), 1, read)
        assert np.allclose(got, np.diff(np.diff(read, axis=0), axis=1) * height * width / picture.size)


def test_memory_of_a_very_long_text(spark):
    """24 MB of text: the hash and the tile take less than a MB beside it, and the query's two steps give its bytes back."""
    import tracemalloc

    text = ("a long text, over and over " * 900_000)[: 24 << 20]
    picture = np.frombuffer(media.payload(text.encode()), np.uint8).reshape(-1, media.ROW)
    tracemalloc.start()
    media.hash_and_tile(picture, 32)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1 << 20
    row = media.media_digest(media.store_text(spark.createDataFrame([(1, text)], "doc_id long, text string"))).first()
    assert row.n_bytes == len(text) and row.payload_sha256 == hashlib.sha256(media.payload(text.encode())).hexdigest()


def test_quality_learns_from_long_texts_on_executors(spark):
    """Labelled texts of half a megabyte: few of them fill the dictionaries' sample, all others calibrate; the driver gets no text."""
    import random

    from pyspark.sql import functions as F
    from tabloom.llm import quality

    rng = random.Random(6)
    words = {q: ["".join(rng.choice("abcdefgh" if q else "qrstuvwx") for _ in range(rng.randint(3, 8))) for _ in range(400)] for q in (0, 1)}
    rows = [(i, " ".join(rng.choice(words[i % 2]) for _ in range(80_000 if i < 60 else 60))) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).cache()
    labels = spark.createDataFrame([(i, i % 2) for i in range(120)], "doc_id long, quality int")
    model = quality.fit(docs, labels, F.lit(True), sample_bytes=2 << 20)
    assert 0 < len(model.good) <= 112 << 10 and len(model.weights) == 7
    right = [(r.score >= 0.5) == bool(r.doc_id % 2) for r in quality.score(docs, model).collect()]
    assert sum(right) >= 118
