"""Image files as rows: integrity, size, content hash and a perceptual hash, without an imaging library.

PNG files are decoded whole (checksums, compressed data, row filters); of JPEG, GIF and BMP the structure is walked up
to the end marker, so truncated files are found, but their pixels are not decoded and they get no perceptual hash.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

MIN_SHORT_SIDE = 224
PNG_SIGNATURE = b"\x89PNG\r\n\x1a\n"
PNG_MODES = {0: ("L", 1), 2: ("RGB", 3), 3: ("P", 1), 4: ("LA", 2), 6: ("RGBA", 4)}
# Fixed values of the JPEG format: markers of frames (they hold the size) and markers without a length.
JPEG_FRAMES = {*range(0xC0, 0xD0)} - {0xC4, 0xC8, 0xCC}
JPEG_BARE = {0x01, *range(0xD0, 0xD9)}


def _png(data: bytes) -> dict:
    at, parts, head, palette, ended = 8, [], None, None, False
    while at < len(data) and not ended:
        size, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + size]
        (crc,) = struct.unpack_from(">I", data, at + 8 + size)
        if zlib.crc32(kind + body) != crc:
            raise ValueError("wrong checksum")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            parts.append(body)
        ended = kind == b"IEND"
        at += size + 12
    if head is None or not ended:
        raise ValueError("truncated file")
    width, height, depth, colour, _, _, interlace = head
    mode, channels = PNG_MODES[colour]
    raw = zlib.decompress(b"".join(parts))
    gray = _png_gray(raw, width, height, channels, mode, palette) if depth == 8 and not interlace else None
    return {"format": "PNG", "mode": mode, "width": width, "height": height, "gray": gray}


def _png_gray(raw: bytes, width: int, height: int, channels: int, mode: str, palette) -> np.ndarray:
    """Brightness of the pixels of an 8-bit image; undoes the row filters."""
    line = width * channels
    if len(raw) != height * (line + 1):
        raise ValueError("wrong amount of pixel data")
    rows = np.frombuffer(raw, np.uint8).reshape(height, line + 1)
    out = np.zeros((height + 1, line), np.uint8)
    for y in range(height):
        kind, row, above = rows[y, 0], rows[y, 1:], out[y]
        if kind == 0:
            out[y + 1] = row
        elif kind == 1:
            out[y + 1] = np.cumsum(row.reshape(-1, channels), axis=0, dtype=np.uint8).reshape(-1)
        elif kind == 2:
            out[y + 1] = row + above
        else:
            out[y + 1] = _sequential_filter(int(kind), row.tolist(), above.tolist(), channels)
    pixels = out[1:].reshape(height, width, channels).astype(np.float64)
    if mode == "P":
        pixels = palette[out[1:]].astype(np.float64)
    return pixels[..., :3] @ np.array([0.299, 0.587, 0.114]) if pixels.shape[2] >= 3 else pixels[..., 0]


def _sequential_filter(kind: int, row: list[int], above: list[int], step: int) -> list[int]:
    """The two filters of which each byte depends on the one before: mean, and nearest of left, above and corner."""
    out = [0] * step
    for i, value in enumerate(row):
        left, up, corner = out[i], above[i], above[i - step] if i >= step else 0
        if kind == 3:
            guess = (left + up) // 2
        elif kind == 4:
            base = left + up - corner
            guess = min((abs(base - left), 0, left), (abs(base - up), 1, up), (abs(base - corner), 2, corner))[2]
        else:
            raise ValueError("unknown row filter")
        out.append((value + guess) & 255)
    return out[step:]


def _jpeg(data: bytes) -> dict:
    at, size = 2, None
    while True:
        if data[at] != 0xFF:
            raise ValueError("marker expected")
        kind = data[at + 1]
        if kind in JPEG_BARE or kind == 0xFF:
            at += 1 if kind == 0xFF else 2
            continue
        (length,) = struct.unpack_from(">H", data, at + 2)
        if kind in JPEG_FRAMES:
            height, width, parts = struct.unpack_from(">HHB", data, at + 5)
            size = (width, height, {1: "L", 3: "RGB", 4: "CMYK"}.get(parts))
        if kind == 0xDA:
            break
        at += 2 + length
    if size is None or data.rstrip(b"\0")[-2:] != b"\xff\xd9":
        raise ValueError("truncated file")
    return {"format": "JPEG", "mode": size[2], "width": size[0], "height": size[1], "gray": None}


def _gif(data: bytes) -> dict:
    width, height = struct.unpack_from("<HH", data, 6)
    if data.rstrip(b"\0")[-1:] != b";":
        raise ValueError("truncated file")
    return {"format": "GIF", "mode": "P", "width": width, "height": height, "gray": None}


def _bmp(data: bytes) -> dict:
    size, _, _, width, height = struct.unpack_from("<IIIxxxxii", data, 2)
    if size > len(data):
        raise ValueError("truncated file")
    (bits,) = struct.unpack_from("<H", data, 28)
    return {"format": "BMP", "mode": {1: "1", 8: "P", 24: "RGB", 32: "RGBA"}.get(bits), "width": width, "height": abs(height), "gray": None}


def perceptual_hash(gray: np.ndarray) -> int:
    """64 bits: which of the 8 x 8 lowest cosine frequencies of a 32 x 32 mean image lie above their median."""
    height, width = gray.shape
    rows, columns = (np.minimum(np.arange(33) * n // 32, n - 1) for n in (height, width))
    sums = np.zeros((height + 1, width + 1))
    sums[1:, 1:] = gray.cumsum(0).cumsum(1)
    y0, y1 = rows[:-1], np.maximum(rows[1:], rows[:-1] + 1)
    x0, x1 = columns[:-1], np.maximum(columns[1:], columns[:-1] + 1)
    area = (y1 - y0)[:, None] * (x1 - x0)[None, :]
    small = (sums[np.ix_(y1, x1)] - sums[np.ix_(y0, x1)] - sums[np.ix_(y1, x0)] + sums[np.ix_(y0, x0)]) / area
    waves = np.cos(np.pi * (np.arange(32) + 0.5)[None, :] * np.arange(8)[:, None] / 32)
    low = waves @ small @ waves.T
    bits = (low > np.median(low)).reshape(-1)
    value = int.from_bytes(np.packbits(bits).tobytes(), "big")
    return value - 2**64 if value >= 2**63 else value


def inspect(data: bytes | None) -> dict:
    """Integrity of one file: a file that cannot be read keeps its hash and says why."""
    out = {"openable": False, "width": None, "height": None, "format": None, "mode": None, "is_low_res": None, "sha256": None, "phash": None, "error": None}
    if data is None:
        return out | {"error": "read_error: no content"}
    out["sha256"] = hashlib.sha256(data).hexdigest()
    readers = ((PNG_SIGNATURE, _png), (b"\xff\xd8", _jpeg), (b"GIF8", _gif), (b"BM", _bmp))
    try:
        found = next((read for start, read in readers if data.startswith(start)), None)
        if found is None:
            raise ValueError("unknown format")
        told = found(data)
        gray = told.pop("gray")
        out |= told | {"openable": True, "is_low_res": min(told["width"], told["height"]) < MIN_SHORT_SIDE, "phash": None if gray is None else perceptual_hash(gray)}
    except (ValueError, KeyError, IndexError, struct.error, zlib.error) as error:
        out["error"] = f"decode_error: {error}"
    return out


FIELDS = pa.schema([
    ("openable", pa.bool_()), ("width", pa.int32()), ("height", pa.int32()), ("format", pa.string()), ("mode", pa.string()),
    ("is_low_res", pa.bool_()), ("sha256", pa.string()), ("phash", pa.int64()), ("error", pa.string()),
])


def inspect_images(files: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """(key, openable, width, height, format, mode, is_low_res, sha256, phash, error), a row for every file."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = [inspect(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([t[f.name] for t in told], f.type) for f in FIELDS)], names=[key, *FIELDS.names])

    kind = dict(files.dtypes)[key]
    ddl = "openable boolean, width int, height int, format string, mode string, is_low_res boolean, sha256 string, phash long, error string"
    return files.select(key, content).mapInArrow(rows, f"`{key}` {kind}, {ddl}")
