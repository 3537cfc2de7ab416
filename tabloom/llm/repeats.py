"""Byte strings of a given length that start at two places or more, and texts without them.

A byte is removed if a string of ``length`` bytes that covers it also starts anywhere else, in
any document, the same included; overlapping places count. Everything is judged on the input.

The strings that start at all places are never listed: that would be a multiple of the texts.

1. Suffixes are sampled: a place is an anchor if the hash of its ``WIDTH`` bytes is the least of
   those in some window of ``length``. A window's least hash depends on its bytes alone, so
   equal strings have anchors at equal offsets. About one place in 85 is one.
2. Anchors whose ``WIDTH`` bytes occur once end here; no string around them repeats.
3. An anchor's surroundings are all bytes of windows that it can lead (``length - WIDTH`` before it,
   ``length`` from it on). Where two anchors have equal surroundings, all strings inside them repeat.
4. What is left are anchors near the ends of a repeated passage. One of each kind of surroundings
   is cut out; by each anchor's bytes, the strings of all their offsets are hashed in
   vectors and compared. The strings that repeat at an anchor all cover it, so the first and
   the last of them bound what is removed.

Every step is an aggregation or a join by hash of anchors that still count, and a
shuffle's sort on disk holds what memory doesn't. A class of anchors that very many different
surroundings share (a licence in a third of all texts) is dealt into shares of about ``CLASS``
by a hash. Each share finds the repeats inside it. Only strings that lie beyond what the share has
found ask whether another share has them, first by blocks of ``BLOCK`` offsets: all strings of a block share
the bytes in its middle, one hash a block. Only blocks whose middle another share has too are
cut out again, and their different strings become rows, counted before they are shuffled. Equal texts are found first and stand
for each other; they are removed whole, if they have ``length`` bytes.

Strings are told apart by 64-bit polynomial hashes of their bytes and the hashes of their anchors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import id_field, lookup, materialise, only, slices
from tabloom.sources.store import forget, release

LENGTH, WIDTH = 200, 32
#: Different surroundings of one class of anchors that are compared together, about 100 MB of hashes; larger classes are dealt into shares.
CLASS = 16_384
#: Offsets whose strings are compared by the bytes that they all share, before they are compared themselves.
BLOCK = 13
#: Bytes of text hashed together; longer texts go piece by piece.
PIECE = 1 << 20
#: Surroundings compared together (whole classes).
FRAGMENTS = 2_048
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BYTES = np.array([xxhash.xxh64_intdigest(bytes([i]), 1) for i in range(256)], np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def rolling(data: np.ndarray, width: int) -> np.ndarray:
    """Polynomial hashes of all strings of ``width`` bytes, along the last axis: strings of doubled widths, put together."""
    part, size = _BYTES[data], 1
    out, held = None, 0
    while True:
        if width & size:
            if out is None:
                out, held = part, size
            else:
                n = data.shape[-1] - held - size + 1
                out = part[..., :n] * np.uint64(pow(int(_BASE), held, 1 << 64)) + out[..., size : size + n]
                held += size
        size *= 2
        if size > width:
            return out
        n = data.shape[-1] - size + 1
        part = part[..., :n] * np.uint64(pow(int(_BASE), size // 2, 1 << 64)) + part[..., size // 2 : size // 2 + n]


def slide(x: np.ndarray, width: int, op: np.ufunc, neutral: int) -> np.ndarray:
    """op over every ``width`` neighbours, by running values to and from the ends of blocks."""
    n = len(x)
    blocks = np.full((-(-n // width), width), neutral, x.dtype)
    blocks.reshape(-1)[:n] = x
    after = op.accumulate(blocks, axis=1).reshape(-1)
    before = op.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return op(before[: n - width + 1], after[width - 1 : n])


def anchors(data: np.ndarray, starts: np.ndarray, length: int = LENGTH, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Places of anchors and the hashes of their bytes. ``starts``: where each text in data starts, and the end of data."""
    if len(data) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    hashes = mixed(rolling(data, width))
    order = np.maximum((hashes >> np.uint64(32)).astype(np.uint32), 1)
    reach = length - width + 1
    least = slide(order, reach, np.minimum, 2**32 - 1)
    for start in starts[1:-1]:  # windows over the end of a text are none
        least[max(0, start - length + 1) : start] = 0
    padded = np.zeros(len(least) + 2 * (reach - 1), np.uint32)
    padded[reach - 1 : reach - 1 + len(least)] = least
    places = np.flatnonzero(slide(padded, reach, np.maximum, 0) == order)
    return places, hashes[places]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[int, int, bytes, int, int]]]:
    """(number, offset, bytes, first, last) of texts or pieces of long ones, PIECE bytes or so together.

    Bytes start at the offset in the text; anchors from first to before last, in bytes, are the piece's own.
    """
    side = LENGTH * 2
    for rows, texts in slices(batches, PIECE):
        run = []
        for number, text in zip(rows.column(0).to_pylist(), texts, strict=True):
            if len(text) <= 2 * PIECE:
                run.append((number, 0, text, 0, len(text)))
                continue
            for at in range(0, len(text), PIECE):
                low = max(0, at - side)
                yield [(number, low, text[low : at + PIECE + side], at - low, min(at + PIECE, len(text)) - low)]
        if run:
            yield run


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """num, p, core, hull, ahead, behind of every anchor; hull is the hash of its surroundings, ahead and behind their sizes."""
    for run in _runs(batches):
        joined = b"".join(r[2] for r in run)
        starts = np.concatenate(([0], np.cumsum([len(r[2]) for r in run])))
        places, cores = anchors(np.frombuffer(joined, np.uint8), starts)
        owner = np.searchsorted(starts, places, side="right") - 1
        inside = places - starts[owner]
        low, high = (np.array([r[i] for r in run], np.int64)[owner] for i in (3, 4))
        own = (inside >= low) & (inside < high)
        places, cores, owner, inside = places[own], cores[own], owner[own], inside[own]
        if not len(places):
            continue
        ahead = np.minimum(inside, LENGTH - WIDTH)
        behind = np.minimum(starts[owner + 1] - places, LENGTH)
        view, digest = memoryview(joined), xxhash.xxh64_intdigest
        hull = np.fromiter((digest(view[p - a : p + b], a) for p, a, b in zip(places.tolist(), ahead.tolist(), behind.tolist(), strict=True)), np.uint64, len(places))
        numbers, offsets = (np.array([r[i] for r in run], np.int64)[owner] for i in (0, 1))
        columns = [numbers, (inside + offsets).astype(np.int32), cores.view(np.int64), hull.view(np.int64), ahead.astype(np.int16), behind.astype(np.int16)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["num", "p", "core", "hull", "ahead", "behind"])


def _fragment_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """core, share, shares, num, p, ahead, piece of the anchors that each text is asked for."""
    for rows, texts in slices(batches, PIECE):
        numbers, asked = rows.column(0).to_pylist(), rows.column(2)
        ends = np.concatenate(([0], np.cumsum(asked.value_lengths().to_numpy(zero_copy_only=False))))
        flat = asked.flatten()
        p, core, shares = (flat.field(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2))
        owner = np.repeat(np.array(numbers, np.int64), np.diff(ends))
        share = (mixed(mixed(owner.view(np.uint64)) + p.astype(np.uint64)) >> np.uint64(8)).astype(np.int64) % shares
        for i, text in enumerate(texts):
            at = p[ends[i] : ends[i + 1]].tolist()
            low = [max(0, x - LENGTH + WIDTH) for x in at]
            pieces = [text[a : x + LENGTH] for a, x in zip(low, at, strict=True)]
            mine = slice(ends[i], ends[i + 1])
            columns = [pa.array(core[mine]), pa.array(share[mine]), pa.array(shares[mine]), pa.array(owner[mine]), pa.array(at, pa.int32()), pa.array([x - a for a, x in zip(low, at, strict=True)], pa.int16()), pa.array(pieces, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["core", "share", "shares", "num", "p", "ahead", "piece"])


def _strings(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the strings at all offsets of fragments, which offsets lie inside the text, and hashes of what the strings of a block share."""
    reach = LENGTH - WIDTH
    data = np.zeros((rows.num_rows, reach + LENGTH), np.uint8)
    ahead = rows.column("ahead").to_numpy().astype(np.int64)
    sizes = np.zeros(rows.num_rows, np.int64)
    for i, piece in enumerate(rows.column("piece").to_pylist()):
        at = reach - ahead[i]
        data[i, at : at + len(piece)] = np.frombuffer(piece, np.uint8)
        sizes[i] = len(piece)
    core = rows.column("core").to_numpy().view(np.uint64)
    column = np.arange(reach + 1)
    keys = np.empty((rows.num_rows, reach + 1), np.uint64)
    offset = mixed(column.astype(np.uint64) * _BASE + np.uint64(1))
    ends = np.arange(0, reach + 1, BLOCK) + BLOCK - 1  # the last offset of every block, where the shared bytes begin
    shared = rows.column("shares").to_numpy() > 1
    middles = np.zeros((rows.num_rows, len(ends)), np.uint64)
    for at in range(0, rows.num_rows, 512):  # few rows at a time, as the steps between are wide
        part = slice(at, at + 512)
        seed = mixed(core[part] ^ _BASE)[:, None]
        keys[part] = mixed(rolling(data[part], LENGTH) + seed + offset[None, :])
        if shared[part].any():
            middles[part] = mixed(rolling(data[part], LENGTH - BLOCK + 1)[:, ends] + seed + mixed(ends.astype(np.uint64) * _BASE + np.uint64(2))[None, :])
    first = (reach - ahead)[:, None]
    return keys, (column >= first) & (column + LENGTH <= first + sizes[:, None]), middles


_EDGES = "num long, s long, e long, core long, share long, middle long, gives short, asks short"


def _edges(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    """num, s, e: what the repeated strings of whole shares of fragments cover.

    Of classes of several shares also num, s, core, share, middle, gives, asks: a block of offsets from s on with
    different strings, the hash of the bytes that they share, and by bits which offsets have strings that the share
    answers for, and which would reach farther than what was found.
    """
    keys, valid, middles = _strings(rows)
    flat, back, counts = np.unique(keys[valid], return_inverse=True, return_counts=True)
    found = np.zeros(keys.shape, bool)
    found[valid] = counts[back] > 1
    hit = found.any(axis=1)
    some = np.flatnonzero(hit)
    reach = LENGTH - WIDTH
    first = found.argmax(axis=1)
    last = reach - found[:, ::-1].argmax(axis=1)
    num, start = rows.column("num").to_numpy(), rows.column("p").to_numpy().astype(np.int64) - reach
    if len(some):
        yield _edge_batch(num[some], start[some] + first[some], start[some] + last[some] + LENGTH, None, None, None, None, None)
    shared = rows.column("shares").to_numpy() > 1
    if not shared.any():
        return
    gives = np.zeros(keys.shape, bool)
    one = np.zeros(len(back), bool)
    one[np.unique(back, return_index=True)[1]] = True
    gives[valid] = one
    gives &= shared[:, None]
    column = np.arange(reach + 1)
    asks = gives & (~hit[:, None] | (column < first[:, None]) | (column > last[:, None]))
    gives, asks = _bits(gives), _bits(asks)
    i, b = np.nonzero(gives)
    core, share = rows.column("core").to_numpy(), rows.column("share").to_numpy()
    for at in range(0, len(i), 1 << 16):
        k, m = i[at : at + (1 << 16)], b[at : at + (1 << 16)]
        yield _edge_batch(num[k], start[k] + m * BLOCK, None, core[k], share[k], middles[k, m].view(np.int64), gives[k, m], asks[k, m])


def _bits(marks: np.ndarray) -> np.ndarray:
    """The marks of every BLOCK columns as the bits of a number."""
    blocks = -(-marks.shape[1] // BLOCK)
    wide = np.zeros((len(marks), blocks * BLOCK), bool)
    wide[:, : marks.shape[1]] = marks
    return (wide.reshape(len(marks), blocks, BLOCK) << np.arange(BLOCK)).sum(axis=2).astype(np.int16)


def _edge_batch(*columns: np.ndarray | None) -> pa.RecordBatch:
    types = (*[pa.int64()] * 6, pa.int16(), pa.int16())
    return pa.RecordBatch.from_arrays([pa.nulls(len(columns[0]), t) if c is None else pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["num", "s", "e", "core", "share", "middle", "gives", "asks"])


def _string_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """num, s, string, asks: the strings of the blocks that each text is asked for."""
    wide = BLOCK + LENGTH - 1
    for rows, texts in slices(batches, PIECE):
        numbers, asked = rows.column(0).to_pylist(), rows.column(2)
        ends = np.concatenate(([0], np.cumsum(asked.value_lengths().to_numpy(zero_copy_only=False))))
        flat = asked.flatten()
        s, core, middle, gives, asks = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(5))
        owner = np.repeat(np.arange(len(texts)), np.diff(ends))
        for at in range(0, len(s), FRAGMENTS):
            part = slice(at, at + FRAGMENTS)
            data = np.zeros((len(s[part]), wide), np.uint8)
            for row, (i, x) in enumerate(zip(owner[part].tolist(), s[part].tolist(), strict=True)):
                piece = np.frombuffer(texts[i][max(0, x) : x + wide], np.uint8)
                data[row, max(0, -x) : max(0, -x) + len(piece)] = piece
            i, o = np.nonzero((gives[part, None] >> np.arange(BLOCK)) & 1)
            offset = mixed(np.arange(BLOCK).astype(np.uint64) * _BASE + np.uint64(1))
            seed = mixed(core[part].view(np.uint64) ^ _BASE) + mixed(middle[part].view(np.uint64))
            string = mixed(rolling(data, LENGTH) + seed[:, None] + offset[None, :])[i, o]
            columns = [pa.array(np.array(numbers, np.int64)[owner[part]][i]), pa.array(s[part][i] + o), pa.array(string.view(np.int64)), pa.array((asks[part][i] >> o) & 1 == 1)]
            yield pa.RecordBatch.from_arrays(columns, ["num", "s", "string", "asks"])


def _edge_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fragments in order of class and share, worked on FRAGMENTS or so together, shares whole."""
    held: list[pa.RecordBatch] = []
    rows, before = 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        core, share = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        start = 0
        turns = np.flatnonzero((np.diff(core) != 0) | (np.diff(share) != 0)) + 1
        for turn in [*([0] if before not in (None, (core[0], share[0])) else []), *turns.tolist()]:
            if rows + turn - start >= FRAGMENTS:
                yield from _edges(pa.Table.from_batches([*held, batch.slice(start, turn - start)]))
                held, rows, start = [], 0, turn
        held.append(batch.slice(start))
        rows += batch.num_rows - start
        before = core[-1], share[-1]
    if rows:
        yield from _edges(pa.Table.from_batches(held))


def covered(texts: DataFrame) -> DataFrame:
    """(num, s, e): runs of bytes that repeated strings cover; runs may overlap. texts: num long, text binary, all different."""
    found = materialise(texts.mapInArrow(_anchor_rows, "num long, p int, core long, hull long, ahead short, behind short"), "anchors")
    total = found.count()
    cores = found.groupBy("core").agg(F.count("*").alias("m")).where("m > 1")
    alive = materialise(lookup(found, materialise(cores, "cores"), "core", "m", total), "alive")
    release(found)
    kinds = alive.groupBy("core", "hull").agg(F.count("*").alias("n"), F.min("num").alias("num"), F.min_by("p", "num").alias("p"))
    kinds = materialise(kinds, "kinds")
    whole = kinds.where("n > 1").select(F.struct("core", "hull").alias("kind"), "n")
    asked = alive.where(F.col("ahead") + F.col("behind") >= LENGTH).withColumn("kind", F.struct("core", "hull"))
    same = materialise(lookup(asked, whole, "kind", "n", alive.count()).select("num", (F.col("p") - F.col("ahead")).cast("long").alias("s"), (F.col("p") + F.col("behind")).cast("long").alias("e")), "same")
    release(alive)
    classes = materialise(kinds.groupBy("core").agg(F.count("*").alias("h")).where("h > 1"), "classes")
    shares = classes.select("core", "h", F.ceil(F.col("h") / CLASS).cast("long").alias("shares"))
    differ = materialise(lookup(kinds.select("core", "num", "p"), shares, "core", "h", kinds.count()), "differ")
    release(kinds)
    wanted = differ.groupBy("num").agg(F.collect_list(F.struct("p", "core", "shares")).alias("asked"))
    fragments = texts.join(wanted, "num").select("num", "text", "asked").mapInArrow(_fragment_rows, "core long, share long, shares long, num long, p int, ahead short, piece binary")
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    edges = materialise(fragments.repartition(parts, "core", "share").sortWithinPartitions("core", "share").mapInArrow(_edge_rows, _EDGES), "edges")
    blocks = edges.where("middle IS NOT NULL").drop("e")
    meet = blocks.groupBy("middle").agg(F.count("*").alias("n"), F.min("share").alias("a"), F.max("share").alias("b"), F.max(F.col("asks") != 0).alias("any"))
    meet = materialise(meet.where("any AND a < b").select("middle", "n"), "meet")
    wanted = lookup(blocks, meet, "middle", "n", blocks.count()).groupBy("num").agg(F.collect_list(F.struct("s", "core", "middle", "gives", "asks")).alias("asked"))
    strings = texts.join(wanted, "num").select("num", "text", "asked").mapInArrow(_string_rows, "num long, s long, string long, asks boolean")
    strings = materialise(strings, "strings")
    twice = materialise(strings.groupBy("string").agg(F.count("*").alias("n")).where("n > 1"), "twice")
    asking = strings.where("asks").select("num", "s", "string")
    again = lookup(asking, twice, "string", "n", asking.count()).select("num", "s", (F.col("s") + LENGTH).alias("e"))
    out = same.unionByName(edges.where("middle IS NULL").select("num", "s", "e")).unionByName(materialise(again, "again"))
    forget(texts.sparkSession)
    return out


def merged(s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of runs; those that touch are one."""
    order = np.argsort(s, kind="stable")
    s, e = s[order], np.maximum.accumulate(e[order])
    new = np.concatenate(([True], s[1:] > e[:-1]))
    return s[new], e[np.concatenate((np.flatnonzero(new)[1:] - 1, [len(s) - 1]))]


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row: doc_id, n_bytes, n_removed, n_spans, spans (array of start and end, in bytes) and kept (binary).

    Null counts as empty text; texts of less than LENGTH bytes stay whole. Repeated rows are
    documents of their own, so a text of LENGTH bytes in two rows goes, whatever the ids; ids
    may be null or clash. Texts of any length are read piece by piece. An empty table gives
    no rows. Other columns stay outside.
    """
    rows = only(docs, doc_id=doc_id, text=text)
    rows = rows.select("doc_id", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text")).withColumn("key", F.md5("text"))
    once = rows.groupBy("key").agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    once = materialise(once.withColumn("num", F.monotonically_increasing_id()), "texts")
    forget(docs.sparkSession)
    runs = covered(once.where(F.octet_length("text") >= LENGTH).select("num", "text"))
    runs = runs.groupBy("num").agg(F.collect_list(F.struct("s", "e")).alias("runs"))
    size = F.octet_length("text").cast("long")
    wide = F.col("copies") > 1
    all_of_it = F.when(size >= LENGTH, F.array(F.struct(F.lit(0).cast("long").alias("s"), size.alias("e"))))
    answers = once.select("key", "num", "copies", F.when(wide, all_of_it).alias("own")).join(runs, "num", "left")
    answers = materialise(answers.select("key", "copies", F.when(wide, F.col("own")).otherwise(F.col("runs")).alias("runs")), "runs")
    release(once)
    found = lookup(rows, answers, "key", "copies", rows.count()).select("doc_id", "text", "runs")
    kind = id_field(rows, "doc_id")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans_type = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))
        for part, texts in slices(batches, 4 * PIECE):
            sizes, removed, spans, kept = [], [], [], []
            for whole, got in zip(texts, part.column(2), strict=True):
                sizes.append(len(whole))
                if not got.is_valid or not len(got.values):
                    removed.append(0)
                    spans.append([])
                    kept.append(whole)
                    continue
                s, e = (got.values.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
                s, e = (x.tolist() for x in merged(s, e))
                removed.append(sum(e) - sum(s))
                spans.append([{"s": a, "e": b} for a, b in zip(s, e, strict=True)])
                kept.append(b"".join(whole[a:b] for a, b in zip([0, *e], [*s, len(whole)], strict=True)))
            columns = [part.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array([len(x) for x in spans], pa.int64()), pa.array(spans, spans_type), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept"])

    return found.mapInArrow(work, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, spans array<struct<s: long, e: long>>, kept binary")
