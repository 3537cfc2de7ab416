"""Media columns: Netpbm and BMP to numpy arrays, area resize by integral images, NPY tiles, difference hashes.

Pictures travel as binary columns. ``media_features`` decodes them; ``store_text`` writes any
text losslessly as 8-bit samples of a grey picture. Null or undecodable media give null
features and never stop a job; empty tables give empty results.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tabloom.llm.common import id_field, only, slices

ROW = 64
#: Height and width of the picture that a difference hash compares.
HASH = (8, 9)
#: Samples that are summed at once.
BAND = 1 << 18


class MediaError(ValueError):
    """The bytes are no picture of a known form."""


#: What decoding of arbitrary bytes raises.
UNREADABLE = (ValueError, OverflowError, struct.error, IndexError)


def _header(data: bytes, count: int) -> tuple[list[int], int]:
    """count numbers of a Netpbm header after the magic, and where the raster begins."""
    found: list[int] = []
    at = 2
    while len(found) < count:
        while at < len(data) and (data[at : at + 1].isspace() or data[at] == 35):
            if data[at] == 35:  # a comment, up to the end of its line
                end = data.find(b"\n", at)
                at = len(data) if end < 0 else end
            at += 1
        start = at
        while at < len(data) and data[at : at + 1].isdigit():
            at += 1
        if start == at:
            raise MediaError("bad Netpbm header")
        found.append(int(data[start:at]))
    return found, at + 1


def read_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6 as an array of height x width (x 3); bitmaps have 0 for black and 255 for white."""
    kind = data[1:2]
    if data[:1] != b"P" or kind not in (b"1", b"2", b"3", b"4", b"5", b"6"):
        raise MediaError("no Netpbm")
    bitmap, colour = kind in b"14", kind in b"36"
    numbers, at = _header(data, 2 if bitmap else 3)
    width, height = numbers[:2]
    top = 1 if bitmap else numbers[2]
    if not width or not height or not 0 < top < 65536:
        raise MediaError("bad Netpbm size")
    shape = (height, width, 3) if colour else (height, width)
    n = width * height * (3 if colour else 1)
    if kind == b"4":
        stride = (width + 7) // 8
        if len(data) - at < stride * height:
            raise MediaError("short raster")
        packed = np.frombuffer(data, np.uint8, stride * height, at).reshape(height, stride)
        return np.where(np.unpackbits(packed, axis=1)[:, :width] > 0, 0, 255).astype(np.uint8)
    if kind in b"123":
        body = b"\n".join(x.split(b"#")[0] for x in data[at - 1 :].split(b"\n"))
        cells = [body[i : i + 1] for i in range(len(body)) if body[i : i + 1] in b"01" and body[i : i + 1]] if bitmap else body.split()
        if len(cells) < n:
            raise MediaError("short raster")
        if any(len(x) > 10 for x in cells[:n]):
            raise MediaError("sample out of range")
        values = np.array([int(x) for x in cells[:n]], np.int64)
        if values.size and not 0 <= values.min() <= values.max() <= (1 if bitmap else top):
            raise MediaError("sample above the largest value")
        return np.where(values > 0, 0, 255).astype(np.uint8).reshape(shape) if bitmap else values.astype(np.uint8 if top < 256 else np.uint16).reshape(shape)
    unit = np.dtype(np.uint8 if top < 256 else ">u2")
    if len(data) - at < n * unit.itemsize:
        raise MediaError("short raster")
    return np.frombuffer(data, unit, n, at).reshape(shape)


def write_netpbm(picture: np.ndarray) -> bytes:
    """A grey or colour 8-bit array as P5 or P6."""
    height, width = picture.shape[:2]
    return b"P%d\n%d %d\n255\n" % (5 if picture.ndim == 2 else 6, width, height) + np.ascontiguousarray(picture, np.uint8).tobytes()


def read_bmp(data: bytes) -> np.ndarray:
    """Uncompressed 8-bit (grey or palette), 24-bit and 32-bit BMP, either row order."""
    if data[:2] != b"BM" or len(data) < 54:
        raise MediaError("no BMP")
    start, head, width, height, planes, bits, packing = struct.unpack_from("<IIiiHHI", data, 10)
    if packing or bits not in (8, 24, 32) or width <= 0 or not height or planes != 1:
        raise MediaError("unsupported BMP")
    stride = (width * bits // 8 + 3) // 4 * 4
    rows = abs(height)
    if len(data) - start < stride * rows:
        raise MediaError("short raster")
    raster = np.frombuffer(data, np.uint8, stride * rows, start).reshape(rows, stride)[:: -1 if height > 0 else 1]
    if bits == 8:
        cells = raster[:, :width]
        colours = struct.unpack_from("<I", data, 46)[0] or 256
        palette = np.frombuffer(data, np.uint8, colours * 4, 14 + head).reshape(-1, 4)[:, :3]
        if (palette == palette[:, :1]).all():
            return palette[:, 0][cells] if (palette[:, 0] != np.arange(colours)).any() else cells
        return palette[:, ::-1][cells]
    return raster[:, : width * bits // 8].reshape(rows, width, bits // 8)[:, :, 2::-1]


def write_bmp(picture: np.ndarray) -> bytes:
    """An 8-bit grey array with a grey palette, or a colour array as 24-bit."""
    height, width = picture.shape[:2]
    grey = picture.ndim == 2
    cells = np.ascontiguousarray(picture, np.uint8) if grey else np.ascontiguousarray(picture[:, :, ::-1], np.uint8).reshape(height, width * 3)
    stride = (cells.shape[1] + 3) // 4 * 4
    raster = np.zeros((height, stride), np.uint8)
    raster[:, : cells.shape[1]] = cells[::-1]
    palette = np.repeat(np.arange(256, dtype=np.uint8), 4).reshape(256, 4) * np.array([1, 1, 1, 0], np.uint8) if grey else np.zeros((0, 4), np.uint8)
    start = 54 + palette.size
    return struct.pack("<2sIHHIIiiHHIIiiII", b"BM", start + raster.size, 0, 0, start, 40, width, height, 1, 8 if grey else 24, 0, raster.size, 2835, 2835, 256 if grey else 0, 0) + palette.tobytes() + raster.tobytes()


def decode(data: bytes) -> np.ndarray:
    return read_bmp(data) if data[:2] == b"BM" else read_netpbm(data)


def white(data: bytes) -> int:
    """The sample value that stands for white: a Netpbm picture's largest value, else 255."""
    return _header(data, 3)[0][2] if data[:1] == b"P" and data[1:2] in b"2356" else 255


def grey(picture: np.ndarray) -> np.ndarray:
    """Luma of a colour picture, by whole-number weights."""
    if picture.ndim == 2:
        return picture
    wide = picture.astype(np.int64)
    return (wide[:, :, 0] * 299 + wide[:, :, 1] * 587 + wide[:, :, 2] * 114) // 1000


def _edges(n: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    at = np.arange(parts + 1) * n
    low = np.minimum(at // parts, n - 1)
    return low, (at - low * parts) / parts


def _between(cells: np.ndarray, starts: np.ndarray, axis: int) -> np.ndarray:
    """Sums along an axis from each start to the next one; large arrays are never widened as a whole."""
    if cells.size <= BAND:
        return np.add.reduceat(cells, starts, axis=axis, dtype=np.int64)
    lines = cells if axis == 0 else cells.T
    out = np.zeros((len(starts), lines.shape[1]), np.int64)
    step = max(1, BAND // lines.shape[1])
    for i, (start, end) in enumerate(zip(starts, [*starts[1:], len(lines)], strict=True)):
        for at in range(start, end, step):
            out[i] += lines[at : min(at + step, end)].sum(axis=0, dtype=np.int64)
    return out if axis == 0 else out.T


@lru_cache(1024)
def _corners(n: int, parts: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Of an axis of n samples cut into equal cells, for each number of cells: where to add up from, which of
    these sums the integral image is read at, and each cell's place among them with its fraction."""
    edges = [_edges(n, p) for p in parts]
    wanted = np.unique(np.concatenate([x for low, _ in edges for x in (low, low + 1)]))
    starts = np.union1d(wanted[wanted < n], [0])
    return starts, np.where(wanted < n, np.searchsorted(starts, wanted), len(starts)), [(np.searchsorted(wanted, low), part) for low, part in edges]


def area_resizes(picture: np.ndarray, shapes: Sequence[tuple[int, int]]) -> list[np.ndarray]:
    """Means over the target cells' areas, for each target (height, width), from one integral image read at fractional corners.

    The integral image (sums of all samples above and left of a corner) is made at the rows and columns that are read,
    the longer side first, so nothing of the picture's size is made.
    """
    h, w = picture.shape
    axes = _corners(h, tuple(x for x, _ in shapes)), _corners(w, tuple(x for _, x in shapes))
    integral = picture
    for axis in (0, 1) if h >= w else (1, 0):
        starts, places, _ = axes[axis]
        sums = _between(integral, starts, axis)
        upto = np.zeros((len(starts) + 1, sums.shape[1]) if axis == 0 else (sums.shape[0], len(starts) + 1), np.int64)
        np.cumsum(sums, axis=axis, out=upto[1:] if axis == 0 else upto[:, 1:])
        integral = upto[places] if axis == 0 else upto[:, places]
    out = []
    for (height, width), (at, part), (beside, rest) in zip(shapes, axes[0][2], axes[1][2], strict=True):
        lines = integral[at] + (integral[at + 1] - integral[at]) * part[:, None]
        corners = lines[:, beside] + (lines[:, beside + 1] - lines[:, beside]) * rest
        out.append(np.diff(np.diff(corners, axis=0), axis=1) * (height * width / (h * w)))
    return out


def area_resize(picture: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean over each target cell's area."""
    return area_resizes(picture, [(height, width)])[0]


def hash_and_tile(picture: np.ndarray, side: int, top: int = 255) -> tuple[str, bytes]:
    """``difference_hash`` and ``npy_tile`` of a grey picture, from one integral image."""
    small, tile = area_resizes(picture, [HASH, (side, side)])
    return _hash(small), _tile(tile, top)


def _hash(small: np.ndarray) -> str:
    steps = np.rint(small * 1024)
    return np.packbits(steps[:, 1:] > steps[:, :-1]).tobytes().hex()


def _tile(cells: np.ndarray, top: int) -> bytes:
    out = io.BytesIO()
    np.lib.format.write_array(out, np.clip(np.rint(cells * (255 / top)), 0, 255).astype(np.uint8), version=(1, 0), allow_pickle=False)
    return out.getvalue()


def difference_hash(picture: np.ndarray) -> str:
    """64 bits, 16 hex digits: whether each of 8 x 8 cells is darker than its right neighbour."""
    return _hash(area_resize(picture, *HASH))


def npy_tile(picture: np.ndarray, side: int, top: int = 255) -> bytes:
    """The picture area-resized to side x side 8-bit samples (top becomes 255), as an NPY file."""
    return _tile(area_resize(picture, side, side), top)


def media_features(df: DataFrame, id_col: str, media_col: str, side: int = 32, slice_bytes: int = 8 << 20) -> DataFrame:
    """Decode a binary column of Netpbm or BMP pictures.

    Per row: the id, height, width, channels (int), dhash (string) and tile (binary, NPY);
    all but the id are null where the media is null or can't be decoded.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, media in slices(batches, slice_bytes):
            rows: list[tuple] = []
            for data in media:
                try:
                    picture = decode(data or b"")
                    light = grey(picture)
                    rows.append((*picture.shape[:2], 1 if picture.ndim == 2 else 3, *hash_and_tile(light, side, white(data))))
                except UNREADABLE:
                    rows.append((None,) * 5)
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], names=[id_col, "height", "width", "channels", "dhash", "tile"])

    return only(df, **{id_col: id_col, "__media": media_col}).mapInArrow(work, f"`{id_col}` {id_field(df, id_col)}, height int, width int, channels int, dhash string, tile binary")


def payload(text: bytes | None) -> bytes:
    """The text's bytes with bytes 0 up to a positive multiple of 64."""
    data = text or b""
    return data + bytes(-len(data) % ROW if data else ROW)


def store_payload(data: bytes, form: str) -> bytes:
    """Bytes, a multiple of 64, as the samples of a grey picture 64 wide, in netpbm or bmp."""
    picture = np.frombuffer(data, np.uint8).reshape(-1, ROW)
    return write_bmp(picture) if form == "bmp" else write_netpbm(picture)


def store_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", form: str = "netpbm", slice_bytes: int = 4 << 20) -> DataFrame:
    """Per row: the id, n_bytes (of the text) and media (the picture that holds the padded text)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, slice_bytes):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x or b"") for x in texts], pa.int64()), pa.array([store_payload(payload(x), form) for x in texts], pa.binary())], names=[id_col, "n_bytes", "media"])

    return only(df, **{id_col: id_col, "__text": text_col}).mapInArrow(work, f"`{id_col}` {id_field(df, id_col)}, n_bytes long, media binary")


def media_digest(df: DataFrame, id_col: str = "doc_id", side: int = 32, slice_bytes: int = 4 << 20) -> DataFrame:
    """Digests of what ``store_text`` stored: every value comes from the stored bytes, read back.

    Columns: the id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes,
    media_sha256 and feature (difference hash, then the sha256 of the NPY tile). Null media
    give null digests; of media that can't be decoded only media_bytes and media_sha256 are known. Beside the media
    and the decoded samples a very long text takes a few MB.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, media in slices(batches, slice_bytes, col=2):
            rows = []
            for data in media:
                if data is None:
                    rows.append((None,) * 6)
                    continue
                whole = len(data), hashlib.sha256(data).hexdigest()
                try:
                    picture = np.ascontiguousarray(decode(data))
                    look, tile = hash_and_tile(grey(picture), side, white(data))
                except UNREADABLE:
                    rows.append((None, None, None, *whole, None))
                    continue
                tail = picture.reshape(-1)[-ROW:].tobytes()
                rows.append((picture.nbytes, hashlib.sha256(picture.data).hexdigest(), zlib.crc32(tail[-ROW:]), *whole, f"{look}:{hashlib.sha256(tile).hexdigest()}"))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            names = [id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], names=names)

    return only(df, **{id_col: id_col, "n_bytes": "n_bytes", "media": "media"}).mapInArrow(work, f"`{id_col}` {id_field(df, id_col)}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
