"""Token counts, packing, media, quality rules, mixing: against plain Python."""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tabloom.llm import cascade, media, mixing, packing, tokens

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(TOKENIZER)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_token_counts(docs, rows, library):
    got = Counter(tuple(r) for r in tokens.token_counts(docs, TOKENIZER, limit=20).collect())
    want = Counter()
    for i, t, *_ in rows:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        want[i, len((t or "").encode()), n, n > 20] += 1
    assert got == want


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("abzAZéÉßİıΣσ.,!'’<|>_ \n\t019日\u0301…«x"), max_size=60))
def test_units_keep_ids(text):
    from tokenizers import Tokenizer

    library = test_units_keep_ids.library = getattr(test_units_keep_ids, "library", None) or Tokenizer.from_file(TOKENIZER)
    own, cut = tokens.encoder(TOKENIZER), tokens.units(text.encode())
    own.learn(set(cut))
    got = np.frombuffer(b"".join(own.ids[u] for u in cut), "<u4").tolist()
    assert got == library.encode(text, add_special_tokens=False).ids


def test_packing(docs, rows, library):
    capacity = 64
    got = packing.tokenize_and_pack(docs, TOKENIZER, capacity).collect()
    want = Counter()
    for i, t, *_ in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), capacity):
            part = ids[k : k + capacity]
            want[i, k // capacity, k, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for spans in by.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(by) <= 1.05 * sum(r.length for r in got) / capacity + 1


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 32), min_size=1, max_size=200))
def test_rounds_are_best_fit_decreasing(lengths):
    runs = packing.plan_runs(Counter(lengths), 32)
    bins = defaultdict(list)
    for length, n in Counter(lengths).items():
        for r in range(n):
            run = runs[length][np.searchsorted(runs[length][:, 0], r, side="right") - 1]
            bins[run[1] + run[2] * (r - run[0])].append((run[3], length))
    for spans in bins.values():
        ends = 0
        for offset, length in sorted(spans):
            assert offset == ends
            ends += length
        assert ends <= 32
    gaps: list[int] = []  # one document after the other
    for x in sorted(lengths, reverse=True):
        fit = [g for g in gaps if g >= x]
        if fit:
            gaps[gaps.index(min(fit))] -= x
        else:
            gaps.append(32 - x)
    assert len(bins) == len(gaps)


def test_media_round_trip(docs, rows):
    for form in ("netpbm", "bmp"):
        got = {r.doc_id: r for r in media.media_digest(media.store_text(docs.where("doc_id IS NOT NULL"), form=form)).collect()}
        for i, t, *_ in rows:
            if i is None:
                continue
            data = (t or "").encode()
            padded = data + bytes(-len(data) % 64 if data else 64)
            r = got[i]
            assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
            stored = media.store_payload(padded, form)
            assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())


def test_media_forms():
    rng = np.random.default_rng(1)
    grey, colour = rng.integers(0, 256, (5, 7), dtype=np.uint8), rng.integers(0, 256, (3, 6, 3), dtype=np.uint8)
    for picture in (grey, colour):
        assert (media.decode(media.write_netpbm(picture)) == picture).all()
        assert (media.decode(media.write_bmp(picture)) == picture).all()
    assert media.decode(b"P1\n# c\n3 2\n1 0 1\n0 1 0\n").tolist() == [[0, 255, 0], [255, 0, 255]]
    assert media.decode(b"P4\n3 2\n\xa0\x40").tolist() == [[0, 255, 0], [255, 0, 255]]
    assert media.decode(b"P2 2 1 255\n7 200").tolist() == [[7, 200]]
    assert media.decode(b"P3 1 1 255 1 2 3").tolist() == [[[1, 2, 3]]]
    assert media.decode(b"P5 1 2 65535\n\x01\x00\x00\x02").tolist() == [[256], [2]]
    for bad in (b"", b"P5", b"P5 9 9 255\nxx", b"P9 1 1", b"BMxx", b"P5 0 3 255\n"):
        with pytest.raises(ValueError):
            media.decode(bad)


def test_area_resize_is_exact():
    rng = np.random.default_rng(2)
    picture = rng.integers(0, 256, (12, 18))
    assert np.allclose(media.area_resize(picture, 4, 6), picture.reshape(4, 3, 6, 3).mean(axis=(1, 3)))
    fine = np.repeat(np.repeat(picture, 5, 0), 7, 1)  # each target cell then holds whole source cells
    assert np.allclose(media.area_resize(picture, 5, 7), fine.reshape(5, 12, 7, 18).mean(axis=(1, 3)))


def test_media_features(spark):
    rng = np.random.default_rng(4)
    picture = rng.integers(0, 256, (40, 50), dtype=np.uint8)
    rows = [(1, media.write_netpbm(picture)), (2, media.write_bmp(picture)), (3, b"junk"), (4, None)]
    got = {r.id: r for r in media.media_features(spark.createDataFrame(rows, "id long, m binary"), "id", "m").collect()}
    assert got[1].dhash == got[2].dhash and got[1].tile == got[2].tile and (got[1].height, got[1].width) == (40, 50)
    tile = np.load(__import__("io").BytesIO(bytes(got[1].tile)))
    assert tile.shape == (32, 32) and tile.dtype == np.uint8
    assert got[3].dhash is None and got[4].height is None


def test_quality_counts(docs, rows):
    text = cascade.text_of("text")
    df = cascade.with_repeats(cascade.with_words(docs, text), "r")
    got = Counter(tuple(r) for r in df.select("doc_id", F.size(cascade.HASHES), cascade.word_chars(text), cascade.n_symbols(text), cascade.n_dup_lines(text), "r", cascade.n_stutters(F.col(cascade.HASHES)), cascade.n_words(text), cascade.n_upper(text)).collect())
    want = Counter()
    for i, t, *_ in rows:
        t = t or ""
        w = words(t)
        lines = [x for x in t.split("\n") if words(x)]
        windows = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        seen = Counter(windows)
        covered = {k + j for k, x in enumerate(windows) if seen[x] > 1 for j in range(5)}
        want[i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered), sum(a == b for a, b in zip(w, w[1:], strict=False)), len(w), sum(c.isupper() for c in t)] += 1
    assert got == want


def test_cascade_order_and_verdict(spark):
    df = spark.range(1000).withColumn("x", F.col("id") % 10)
    rules = [cascade.Rule("never", F.col("x") > 99), cascade.Rule("half", F.col("x") < 5), cascade.Rule("null", F.lit(None).cast("boolean"))]
    order = cascade.order_rules(df, rules)
    assert order[0].name == "half"
    assert df.where(cascade.cascade(order).isNull()).count() == 500
    assert cascade.order_rules(df.where("false"), rules) == rules


def brute_mix(rows, epochs=3.0):
    size = [len(words(t)) for _, t, *_ in rows]
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is None, s or ""))
    total, cap = sum(size), {s: epochs * sum(n for n, r in zip(size, rows, strict=True) if r[3] == s) for s in sources}
    weight, fixed = {s: (1, 2, 3)[i % 3] for i, s in enumerate(sources)}, {}
    while True:
        open_ = [s for s in sources if s not in fixed]
        left = total - sum(fixed.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > cap[s]]
        if not over:
            return size, {**fixed, **share}
        fixed |= {s: cap[s] for s in over}


def test_mixing(docs, rows):
    size, target = brute_mix(rows)
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    again = mixing.mix(docs.repartition(5)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    taken = defaultdict(int)
    for r in got:
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 3 * r.size
        assert abs(r.target - target[r.source]) < 1e-6
    for s, n in taken.items():
        assert abs(n - target[s]) <= 1
    assert Counter((r.doc_id, r.size) for r in got) == Counter((r[0], n) for r, n in zip(rows, size, strict=True))


def test_mixing_clamps(spark):
    rows = [(1, "a b", None, "a", 0), (2, "c " * 400, None, "b", 0), (3, "d", None, "c", 0), (4, None, None, "d", 0)]
    got = {r.doc_id: r for r in mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")).collect()}
    assert (got[1].taken, got[3].taken, got[4].taken) == (6, 3, 0)
    assert got[2].taken == 403 - 9


def test_apply_mix(spark, rows):
    own = [r for r in rows if r[0] is not None]
    own = list({r[0]: r for r in own}.values())
    df = spark.createDataFrame(own, "doc_id long, text string, lang string, source string, n_chars long")
    mixed = mixing.mix(df)
    taken = {r.doc_id: r.taken for r in mixed.collect()}
    out = defaultdict(int)
    for r in mixing.apply_mix(df, mixed).collect():
        out[r.doc_id] += len(words(r.text))
    assert {k: v for k, v in taken.items() if v} == dict(out)


def test_empty_tables(empty):
    assert tokens.token_counts(empty, TOKENIZER).count() == 0
    assert packing.tokenize_and_pack(empty, TOKENIZER).count() == 0
    assert media.media_digest(media.store_text(empty)).count() == 0
    assert mixing.mix(empty).count() == 0
    assert cascade.with_repeats(cascade.with_words(empty, cascade.text_of("text")), "r").count() == 0
