"""Media columns: Netpbm and BMP bytes decoded to numpy, resized by integral images, written as NPY tiles with hashes."""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_map

#: Payloads are padded with 255 to a positive multiple of this: 576 grey samples, or 192 pixels of three, in a row.
UNIT = 576
TILE = 16

_SPACE = rb"(?:\s|#[^\n\r]*[\n\r])+"
_NETPBM = re.compile(rb"P([1-6])" + _SPACE + rb"(\d{1,9})" + _SPACE + rb"(\d{1,9})")
_TOP = re.compile(_SPACE + rb"(\d{1,9})")
_NOTE = re.compile(rb"#[^\n\r]*")


def encode(samples: np.ndarray, kind: str = "pgm") -> bytes:
    """uint8 samples (rows x columns, or x 3) as binary Netpbm (pgm, ppm) or uncompressed BMP (bmp, 24 bits)."""
    height, width = samples.shape[:2]
    if kind in ("pgm", "ppm"):
        if (samples.ndim == 2) != (kind == "pgm"):
            raise ValueError(f"{kind} needs {'one sample' if kind == 'pgm' else 'three samples'} a pixel")
        return b"P%d\n%d %d\n255\n" % (5 if kind == "pgm" else 6, width, height) + samples.tobytes()
    if kind != "bmp":
        raise ValueError(f"unknown kind {kind!r}")
    pixels = samples if samples.ndim == 3 else np.repeat(samples[:, :, None], 3, axis=2)
    stride = -(-width * 3 // 4) * 4
    rows = np.zeros((height, stride), np.uint8)
    rows[:, : width * 3] = pixels[::-1, :, ::-1].reshape(height, width * 3)  # rows from the bottom, blue first
    size = stride * height
    return struct.pack("<2sIHHI", b"BM", 54 + size, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 24, 0, size, 2835, 2835, 0, 0) + rows.tobytes()


def _netpbm(media: bytes, m: re.Match) -> np.ndarray:
    """P1 to P6: bits, greys or colours as text (1 to 3) or bytes (4 to 6)."""
    kind, width, height = (int(x) for x in m.groups())
    at, top, bits = m.end(), 1, kind in (1, 4)
    if not bits:
        if not (m := _TOP.match(media, at)) or not 0 < int(m[1]) < 65536:
            raise ValueError("the highest sample is missing or out of range")
        at, top = m.end(), int(m[1])
    depth = 3 if kind in (3, 6) else 1
    need = width * height * depth
    if kind > 3:
        if not media[at : at + 1].isspace():
            raise ValueError("no white space before the samples")
        stride = -(-width // 8) if kind == 4 else width * depth
        code = np.dtype(">u2") if top > 255 else np.dtype(np.uint8)
        if len(media) - at - 1 < stride * height * code.itemsize:
            raise ValueError("the samples end early")
        values = np.frombuffer(media, code, stride * height, at + 1)
        values = np.unpackbits(values.reshape(height, stride), axis=1)[:, :width].ravel() if kind == 4 else values
    else:
        body = _NOTE.sub(b"", media[at:])
        found = np.frombuffer(bytes(c for c in body if c in b"01"), np.uint8) - 48 if kind == 1 else np.array(body.split()[:need], np.int64)
        if len(found) < need:
            raise ValueError("the samples end early")
        values = found[:need]
    if need and values.max() > top:
        raise ValueError("a sample is above the highest one")
    if bits:
        values = (1 - values) * np.uint8(255)  # 1 is black
    elif top != 255:
        values = (values.astype(np.int64) * 255 + top // 2) // top
    return values.astype(np.uint8, copy=False).reshape((height, width) if depth == 1 else (height, width, 3))


def decode(media: bytes) -> np.ndarray:
    """Netpbm (P1 to P6, samples of up to 16 bits) or BMP (8-bit palette, 24 or 32 bits, uncompressed) as a uint8 array.

    Samples of another range are scaled to 0 to 255. Raises ValueError for anything else and for files that end early.
    """
    if m := _NETPBM.match(media):
        return _netpbm(media, m)
    if media[:2] == b"BM" and len(media) >= 54:
        at, head = struct.unpack_from("<II", media, 10)
        width, height, _, bits, packed = struct.unpack_from("<iiHHI", media, 18)
        if bits not in (8, 24, 32) or packed or width <= 0 or not height:
            raise ValueError("only uncompressed BMP of 8, 24 or 32 bits is read")
        stride = -(-width * bits // 32) * 4
        if len(media) - at < stride * abs(height):
            raise ValueError("the samples end early")
        rows = np.frombuffer(media, np.uint8, stride * abs(height), at).reshape(abs(height), stride)
        rows = rows[::-1] if height > 0 else rows
        if bits == 8:
            used = struct.unpack_from("<I", media, 46)[0] or 256
            if used > 256 or len(media) < 14 + head + used * 4 or rows[:, :width].max() >= used:
                raise ValueError("the palette ends early")
            palette = np.frombuffer(media, np.uint8, used * 4, 14 + head).reshape(used, 4)
            return palette[rows[:, :width]][:, :, 2::-1]
        return rows[:, : width * bits // 8].reshape(abs(height), width, bits // 8)[:, :, 2::-1]
    raise ValueError("neither Netpbm nor BMP")


def integral(grey: np.ndarray) -> np.ndarray:
    out = np.zeros((grey.shape[0] + 1, grey.shape[1] + 1), np.int64)
    np.cumsum(np.cumsum(grey, axis=0, dtype=np.int64), axis=1, out=out[1:, 1:])
    return out


def area_resize(sums: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean over each cell's exact area, part pixels by their share, from an integral image."""

    def at(n: int, cells: int) -> tuple[np.ndarray, np.ndarray]:
        edge = np.arange(cells + 1) * n
        low = np.minimum(edge // cells, n - 1)
        return low, (edge - low * cells) / cells

    (y, fy), (x, fx) = at(sums.shape[0] - 1, height), at(sums.shape[1] - 1, width)
    rows = sums[y] * (1 - fy)[:, None] + sums[y + 1] * fy[:, None]
    grid = rows[:, x] * (1 - fx) + rows[:, x + 1] * fx
    cells = grid[1:, 1:] - grid[:-1, 1:] - grid[1:, :-1] + grid[:-1, :-1]
    return cells * (height * width / ((sums.shape[0] - 1) * (sums.shape[1] - 1)))


def difference_hash(sums: np.ndarray) -> str:
    """64 bits: whether each of 8 x 9 area means is below its right neighbour."""
    small = np.round(area_resize(sums, 8, 9), 6)
    return np.packbits(small[:, 1:] > small[:, :-1]).tobytes().hex()


def npy(tile: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.lib.format.write_array(out, tile, version=(1, 0), allow_pickle=False)
    return out.getvalue()


def grey(samples: np.ndarray) -> np.ndarray:
    return samples if samples.ndim == 2 else samples.astype(np.uint16).sum(axis=2) // 3


def features(media: bytes) -> tuple[str, bytes]:
    """Difference hash and NPY tile of stored media."""
    return _features(decode(media))


def _features(samples: np.ndarray) -> tuple[str, bytes]:
    if not samples.size:
        raise ValueError("an image without pixels")
    sums = integral(grey(samples))
    tile = np.clip(np.rint(area_resize(sums, TILE, TILE)), 0, 255).astype(np.uint8)
    return difference_hash(sums), npy(tile)


def media_columns(df: DataFrame, column: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """The columns of ``keep``, then width, height, channels, dhash, tile (NPY) and error of each row's image bytes.

    A row gives a row. Bytes that are null, empty, of another format, broken or without pixels have a text in ``error``
    and null in the other columns; error is null otherwise. Images of any size are read whole, one at a time.
    """
    part = df.select(*(df[c] for c in keep), df[column].cast("binary").alias("_media"))
    fields = [("width", pa.int32()), ("height", pa.int32()), ("channels", pa.int32()), ("dhash", pa.string()), ("tile", pa.binary()), ("error", pa.string())]

    def one(media: bytes | None) -> tuple:
        try:
            samples = decode(media or b"")
            mark, tile = _features(samples)
            return samples.shape[1], samples.shape[0], 1 if samples.ndim == 2 else 3, mark, tile, None
        except (ValueError, struct.error) as e:
            return None, None, None, None, None, str(e)

    def run(batches):
        for batch in batches:
            rows = [one(m.as_py()) for m in batch.column(len(keep))]
            columns = [pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), fields, strict=True)] if rows else [pa.array([], t) for _, t in fields]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *columns], names=[*keep, *(n for n, _ in fields)])

    own = [f"`{f.name}` {f.dataType.simpleString()}" for f in part.schema.fields[:-1]]
    return arrow_map(part, run, ", ".join([*own, "width int, height int, channels int, dhash string, tile binary, error string"]))


def store_text(data: bytes, kind: str) -> bytes:
    data = data + b"\xff" * ((-len(data)) % UNIT or (UNIT if not data else 0))
    samples = np.frombuffer(data, np.uint8)
    return encode(samples.reshape(-1, UNIT) if kind == "pgm" else samples.reshape(-1, UNIT // 3, 3), kind)


def text_media(docs: DataFrame, kind: str = "pgm", keep_media: bool = True) -> DataFrame:
    """Every text as stored media: doc_id, n_bytes, read-back digests, feature, NPY tile, and media (with keep_media).

    A null text counts as empty, which is one row of padding. Texts of any length are stored whole. Repeated rows and
    null ids give a row each; extra columns are not read; an empty table gives an empty one. ``feature`` is the
    difference hash and the tile's digest.
    """
    fields = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]
    fields += [("tile", pa.binary()), *([("media", pa.binary())] if keep_media else [])]
    schema = pa.schema(fields)

    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            for lo in range(0, len(ids), 512):  # media of at most so many texts are held at once
                rows = []
                for text in batch.column(1).slice(lo, 512).to_pylist():
                    data = (text or "").encode()
                    media = store_text(data, kind)
                    back = decode(media).tobytes()
                    mark, tile = features(media)
                    row = (len(data), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), f"{mark}:{hashlib.sha256(tile).hexdigest()[:16]}")
                    rows.append(row + ((tile, media) if keep_media else (tile,)))
                columns = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), list(schema)[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([ids.slice(lo, 512).cast(pa.int64()), *columns], schema=schema)

    kinds = {pa.int64(): "long", pa.string(): "string", pa.binary(): "binary"}
    return arrow_map(docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]), run, ", ".join(f"{n} {kinds[t]}" for n, t in fields))
