"""SimHash near-duplicates by pivot distance tables.

A fingerprint has 64 bits; bit i is 1 if it is set in over half of the XXH64 hashes (seed 42)
of the text's word shingles, repeats included. Two fingerprints link at ``radius`` or fewer
differing bits; a document's component is everything reachable over links.

Finding the links, over distinct fingerprints only:

1. The bits still free are dealt into blocks. Two fingerprints within ``radius`` agree on at
   least ``blocks - radius`` of them, so they meet in at least one bucket of equal blocks.
2. In a bucket, a table holds every member's Hamming distances to ``PIVOTS`` reference
   fingerprints. By the triangle inequality a pair is within the radius only if no
   coordinate differs by more than it; other pairs are discarded unseen.
3. Survivors are verified bit by bit. A member that is linked leaves the table at once, so a
   bucket of n near copies costs about n steps, and gives n - 1 links, not all its pairs:
   they connect exactly what all links together connect.

A bucket above ``max_bucket`` is not worked on: its members are dealt again by their free
bits, level after level. Each level fixes about two fifths of the free bits, so the fourth
has at most a few hundred members a bucket; nothing is capped or lost.

Texts of a given similarity of shingle sets lie farther apart than a radius of few bits. For
them (``similarity``), buckets are equal classes of shingles, which texts that differ little
share, and wide fingerprints of 1,024 bits judge the pairs: at a similarity of 0.8 they differ
in 155 bits with a standard error of 11, and the limit is at 166.

A text without words has fingerprint zero, which links like any other. Null ids are rows as
all others; a component's id is its least non-null id. Copies of a text share a fingerprint
and are one node.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import id_field, lookup, materialise, only, slices
from tabloom.llm.components import components
from tabloom.sources.store import forget

SEED = 42
PIVOTS = 32
_LANES = np.uint64(0x0101010101010101)
#: Reference fingerprints: fixed pseudo-random words, the same in every run and on every machine.
_PIVOTS = np.array([xxhash.xxh64_intdigest(b"pivot %d" % i, SEED) for i in range(PIVOTS)], np.uint64)


def shingle_hashes(text: bytes | None, width: int = 3) -> np.ndarray:
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[: len(words) - width])).tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[i:j], SEED) for i, j in zip(starts, (ends[width - 1 :] - 1).tolist(), strict=True)), np.uint64, len(starts))


def fingerprint(hashes: np.ndarray) -> int:
    """Bits set in over half of the hashes. Eight bit counts travel in the bytes of one word, 255 hashes at a time."""
    if not len(hashes):
        return 0
    marks = np.arange(0, len(hashes), 255)
    counts = np.empty(64, np.int64)
    for bit in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(bit)) & _LANES, marks)
        counts[bit::8] = lanes.astype("<u8").view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    return int(sum(1 << i for i in np.flatnonzero(2 * counts > len(hashes)).tolist()))


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, slice_bytes: int = 4 << 20) -> DataFrame:
    """Per row: the id and fp, the fingerprint as a signed 64-bit integer."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, slice_bytes):
            found = np.array([fingerprint(shingle_hashes(t, width)) for t in texts], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=[id_col, "fp"])

    return only(df, **{id_col: id_col, "__text": text_col}).mapInArrow(work, f"`{id_col}` {id_field(df, id_col)}, fp long")


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads keys over partitions."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _choices(mask: int, radius: int, spare: int) -> list[int]:
    """Masks of the blocks that a pair may agree on, over the bits that mask leaves free."""
    free = [i for i in range(64) if not mask >> i & 1]
    blocks = [part.tolist() for part in np.array_split(np.array(free, np.int64), radius + spare)]
    return [sum(1 << i for block in chosen for i in block) for chosen in itertools.combinations(blocks, spare)]


def _deal(rows: DataFrame, radius: int, spare: int) -> DataFrame:
    """From (key, mask, fp) to a row for each choice of blocks among the free bits."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, masks, fps = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) for i in range(3))
            for mask in np.unique(masks).tolist():
                own = masks == np.uint64(mask)
                key, fp = keys[own], fps[own]
                for chosen in _choices(mask, radius, spare):
                    new = _mix(_mix(key + np.uint64(chosen)) ^ (fp & np.uint64(chosen)))
                    both = np.full(len(fp), np.uint64(mask | chosen), np.uint64)
                    yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (new, both, fp)], names=["key", "mask", "fp"])

    return rows.mapInArrow(work, "key long, mask long, fp long")


def link_bucket(fps: np.ndarray, radius: int, table: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that connect exactly what all links among distinct fingerprints connect: a tree for each component."""
    table = np.bitwise_count(fps[:, None] ^ _PIVOTS).astype(np.int8) if table is None else table
    rest, links = np.arange(len(fps)), []
    while len(rest) > 1:
        front, rest = [int(rest[0])], rest[1:]
        while front and len(rest):
            x = front.pop()
            near = rest
            for at in range(0, PIVOTS, 8):  # discard by the coordinates, eight at a time
                near = near[(np.abs(table[near, at : at + 8] - table[x, at : at + 8]) <= radius).all(axis=1)]
                if not len(near):
                    break
            near = near[np.bitwise_count(fps[near] ^ fps[x]) <= radius]
            if len(near):
                links += [(int(fps[x]), int(fps[y])) for y in near]
                front += near.tolist()
                rest = np.setdiff1d(rest, near, assume_unique=True)
    return links


def _link(rows: DataFrame, radius: int, max_bucket: int) -> DataFrame:
    """From sorted buckets to links (kind 0: a, b) and to members of buckets that are too large (kind 1: key, fp)."""
    names = ["kind", "a", "b", "mask"]

    def out(kind: int, a: np.ndarray, b: np.ndarray, mask: int) -> pa.RecordBatch:
        n = len(a)
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), *(pa.array(np.asarray(x, np.uint64).view(np.int64)) for x in (a, b)), pa.array(np.full(n, mask, np.int64))], names=names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, held_mask, held, count, spilling = None, 0, [], 0, False

        def close() -> Iterator[pa.RecordBatch]:
            if held_key is not None and not spilling and count > 1:
                links = link_bucket(np.concatenate(held), radius)
                if links:
                    a, b = zip(*links, strict=True)
                    yield out(0, np.array(a, np.uint64), np.array(b, np.uint64), 0)

        for batch in batches:
            if not batch.num_rows:
                continue
            keys, masks, fps = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3))
            fps = fps.view(np.uint64)
            starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            stops = np.append(starts[1:], len(keys))
            # buckets of one inside the batch have nothing to link
            last = len(starts) - 1
            for at in np.flatnonzero((stops - starts > 1) | (np.arange(len(starts)) == 0) | (np.arange(len(starts)) == last)).tolist():
                start, stop = int(starts[at]), int(stops[at])
                if held_key is None or keys[start] != held_key:
                    yield from close()
                    held_key, held_mask, held, count, spilling = keys[start], int(masks[start]), [], 0, False
                held.append(fps[start:stop])
                count += stop - start
                if count > max_bucket:
                    spilling = True
                if spilling:
                    members = np.concatenate(held)
                    yield out(1, np.full(len(members), held_key, np.int64).view(np.uint64), members, held_mask)
                    held = []
        yield from close()

    return rows.mapInArrow(work, "kind int, a long, b long, mask long")


def links(classes: DataFrame, radius: int = 3, max_bucket: int = 2_000, spare: int | None = None) -> DataFrame:
    """Links (a, b) among distinct fingerprints (column fp) that connect exactly what all pairs within radius connect."""
    spark = classes.sparkSession
    if spare is None:  # about 26 bits a bucket for some hundred millions of fingerprints, about 32 beyond
        spare = 2 if classes.count() < 1 << 28 else 3
    rows = classes.select(F.lit(0).cast("long").alias("key"), F.lit(0).cast("long").alias("mask"), "fp")
    found = None
    while True:
        dealt = _deal(rows, radius, spare)
        sorted_rows = dealt.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "key").sortWithinPartitions("key")
        got = materialise(_link(sorted_rows, radius, max_bucket), "simhash-links")
        part = got.where("kind = 0").select("a", "b")
        found = part if found is None else found.unionAll(part)
        large = got.where("kind = 1")
        if large.isEmpty():
            return found
        rows = large.select(F.col("a").alias("key"), "mask", F.col("b").alias("fp"))


def _answers(rows: DataFrame, id_col: str, radius: int, max_bucket: int, wide: DataFrame | None) -> DataFrame:
    """Rows (id, fp) with the least id of their component; wide: links among fps beside those within the radius."""
    classes = materialise(rows.groupBy("fp").agg(F.min(f"`{id_col}`").alias("least"), F.count("*").alias("n")), "simhash-classes")
    near = links(classes.select("fp"), radius, max_bucket)
    if wide is not None:
        near = near.unionAll(wide)
    forget(rows.sparkSession)
    roots = materialise(components(near), "simhash-roots")
    forget(rows.sparkSession)
    linked = classes.join(roots, classes.fp == roots.node, "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root"), F.col("root").isNotNull().alias("linked"))
    groups = linked.where("linked").groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("members"))
    own = linked.where("linked").select("fp", "n", "root")
    answer = lookup(own, groups, "root", "members", classes.count()).select("fp", "n", "component_id")
    answer = answer.unionAll(linked.where("NOT linked").select("fp", "n", F.col("least").alias("component_id")))
    # a fingerprint of very many copies is answered by a broadcast
    return lookup(rows, answer, "fp", "n", rows.count()).select(F.col(f"`{id_col}`"), "fp", "component_id")


#: Lanes of 64 bits of a wide fingerprint, its class size and the classes of a text that become buckets.
LANES = 16
CLASS_SHINGLES, CLASSES = 3, 12
_SEEDS = np.array([xxhash.xxh64_intdigest(b"lane %d" % i, SEED) for i in range(LANES)], np.uint64)[:, None]


def wide_fingerprint(hashes: np.ndarray, step: int = 1 << 16) -> np.ndarray:
    """LANES fingerprints side by side, each of the hashes mixed with a seed of its own; ``step`` hashes at a time."""
    counts = np.zeros((LANES, 64), np.int64)
    for at in range(0, len(hashes), step):
        mixed = _mix(hashes[None, at : at + step] ^ _SEEDS)
        marks = np.arange(0, mixed.shape[1], 255)
        for bit in range(8):
            lanes = np.add.reduceat((mixed >> np.uint64(bit)) & _LANES, marks, axis=1)
            counts[:, bit::8] += lanes.astype("<u8").view(np.uint8).reshape(LANES, -1, 8).sum(axis=1, dtype=np.int64)
    return np.packbits(2 * counts > len(hashes), axis=1, bitorder="little").view("<u8").reshape(LANES)


def class_keys(hashes: np.ndarray) -> list[int]:
    """Keys of classes of a text's distinct shingles; texts that differ little have equal classes.

    Shingles are dealt by their hash into 2^g classes of about CLASS_SHINGLES to twice as
    many; the first CLASSES of them give a key each, of all their shingles. Texts that are up
    to a quarter larger may have one more g: a text gives the keys of that g, too.
    """
    own = np.unique(hashes)
    if not len(own):
        return []
    place, keys = own >> np.uint64(32), []
    for g in sorted({max(0, int(np.log2(len(own) * f / CLASS_SHINGLES))) for f in (1.0, 1.25)}):
        classes = place & np.uint64((1 << g) - 1)
        for k in range(min(1 << g, CLASSES)):
            members = own[classes == k]
            if len(members):
                keys.append(xxhash.xxh64_intdigest(members.tobytes(), g << 8 | k))
    return np.array(keys, np.uint64).view(np.int64).tolist()


def wide_radius(similarity: float) -> int:
    """The differing bits at which texts of this similarity of shingle sets lie, and one standard error more."""
    share = float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)
    bits = 64 * LANES
    return int(bits * share + (bits * share * (1 - share)) ** 0.5)


def link_wide(fps: np.ndarray, prints: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links of a bucket that connect what all links among its wide fingerprints connect; linked members leave at once."""
    rest, links = np.arange(len(fps)), []
    while len(rest) > 1:
        front, rest = [int(rest[0])], rest[1:]
        while front and len(rest):
            x = front.pop()
            near = np.bitwise_count(prints[rest] ^ prints[x]).sum(axis=1, dtype=np.int64) <= radius
            if near.any():
                hit = rest[near]
                links += [(int(fps[x]), int(fps[y])) for y in hit]
                front += hit.tolist()
                rest = rest[~near]
    return links


def _wide_rows(df: DataFrame, id_col: str, text_col: str, width: int, slice_bytes: int = 4 << 20) -> DataFrame:
    """Per row: the id, fp, print (the wide fingerprint) and keys (of its classes)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, slice_bytes):
            rows = []
            for text in texts:
                hashes = shingle_hashes(text, width)
                rows.append((fingerprint(hashes), wide_fingerprint(hashes).tobytes(), class_keys(hashes)))
            fps, prints, keys = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(prints, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=[id_col, "fp", "print", "keys"])

    return only(df, **{id_col: id_col, "__text": text_col}).mapInArrow(work, f"`{id_col}` {id_field(df, id_col)}, fp long, print binary, keys array<long>")


def wide_links(rows: DataFrame, radius: int, max_bucket: int) -> DataFrame:
    """Links (a, b) among fingerprints whose wide fingerprints lie within the radius and that share a class key.

    Keys that only one fingerprint has leave before any wide fingerprint is moved. The members
    of a key of more than ``max_bucket`` are dealt into blocks, and every two blocks make a
    bucket: no pair of the key is left out.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    one = materialise(rows.groupBy("fp").agg(F.min(F.struct("print", "keys")).alias("x")).select("fp", "x.print", "x.keys"), "simhash-wide")
    keyed = one.select("fp", F.explode("keys").alias("key"))
    total = one.agg(F.sum(F.size("keys"))).first()[0] or 0
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / max_bucket).cast("int").alias("blocks")
    met = lookup(keyed, shared.select("key", "n", blocks), "key", "n", total)
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.xxhash64("key", F.least(own, j), F.greatest(own, j)))
    dealt = met.select("fp", F.explode(pairs).alias("bucket")).join(one.select("fp", "print"), "fp").select("bucket", "fp", "print")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: int | None = None
        fps: list[int] = []
        prints: list[bytes] = []

        def close() -> Iterator[pa.RecordBatch]:
            if len(fps) > 1:
                got = link_wide(np.array(fps, np.int64), np.frombuffer(b"".join(prints), "<u8").reshape(len(fps), LANES), radius)
                if got:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*got, strict=True)], names=["a", "b"])

        for batch in batches:
            for bucket, fp, wide in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if bucket != now:
                    yield from close()
                    now, fps, prints = bucket, [], []
                fps.append(fp)
                prints.append(wide)
        yield from close()

    return materialise(dealt.repartition(parts, "bucket").sortWithinPartitions("bucket", "fp").mapInArrow(work, "a long, b long").distinct(), "simhash-wide-links")


def near_duplicates(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 3, max_bucket: int = 2_000, similarity: float | None = None
) -> DataFrame:
    """Per row: the id, fp and component_id (the least id reachable, its own included).

    With ``similarity`` texts link, beside those within the radius, if their shingle sets are
    about as similar as that, as judged by wide fingerprints (``wide_links``).
    """
    if similarity is None:
        rows = materialise(fingerprints(df, id_col, text_col, width), "simhash-fps")
        return _answers(rows, id_col, radius, max_bucket, None)
    rows = materialise(_wide_rows(df, id_col, text_col, width), "simhash-fps")
    return _answers(rows.select(f"`{id_col}`", "fp"), id_col, radius, max_bucket, wide_links(rows, wide_radius(similarity), max_bucket))
