"""Media columns: ISO base media containers, written and read without a codec.

A container is a tree of boxes (32-bit size, four-character type, body).  The
reader walks the nested boxes, decodes the sample tables (``stsz``, ``stsc``,
``stco``/``co64``, ``stts``, ``stss``) and yields codec, duration and the byte
ranges of the key frames; media payloads are never decoded.  The writer stores
bytes losslessly as frames of uncompressed 8-bit monochrome video and lists one
frame in KEY_EVERY as a key frame (``stss``), where a reader may enter.

Of several tracks the first one of video is read, else the first.  Files whose
samples are in fragments (``moof``) are not supported and give nulls, as do
bytes that are no container or whose tables claim more than the file can hold.

Edge cases: a null payload is an empty one; an empty payload is padded to one
frame; the container holds no clock, name or key, so equal payloads make equal
containers; boxes may be nested to any depth.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._batches import map_documents

FRAME_SIDE = 24
FRAME_BYTES = FRAME_SIDE * FRAME_SIDE
PAD = b"\xff"
FRAMES_PER_CHUNK = 64
KEY_EVERY = 12
TIMESCALE = 25

# Fixed values of the container format: boxes that hold only boxes.
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"dinf", b"stbl", b"edts", b"udta", b"mvex", b"moof", b"traf"}
UNITY_MATRIX = struct.pack(">9i", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def _box(kind: bytes, *body: bytes) -> bytes:
    content = b"".join(body)
    if len(content) + 8 < 2**32:
        return struct.pack(">I4s", len(content) + 8, kind) + content
    return struct.pack(">I4sQ", 1, kind, len(content) + 16) + content


def _full(kind: bytes, version: int, flags: int, *body: bytes) -> bytes:
    return _box(kind, struct.pack(">I", version << 24 | flags), *body)


def padded(data: bytes, unit: int = FRAME_BYTES) -> bytes:
    """``data`` filled with bytes 255 up to a positive multiple of ``unit``."""
    return data + PAD * (max(unit, -(-len(data) // unit) * unit) - len(data))


def write_container(payload: bytes, key_every: int = KEY_EVERY) -> bytes:
    """An ISO media file whose one video track holds ``payload`` as uncompressed 8-bit frames.

    With ``key_every`` 1 all frames are key frames and there is no table of them.
    """
    if not payload or len(payload) % FRAME_BYTES:
        raise ValueError("the payload must be a positive multiple of a frame")
    frames = len(payload) // FRAME_BYTES
    chunks = -(-frames // FRAMES_PER_CHUNK)
    ftyp = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso4mif2")
    pixel = (
        _box(b"cmpd", struct.pack(">IH", 1, 0)),
        _full(b"uncC", 0, 0, struct.pack(">4sIHBBB", bytes(4), 1, 0, 7, 0, 0), struct.pack(">BBBBIIIII", 0, 0, 0, 0, 0, 0, 0, 0, 0)),
    )
    entry = _box(
        b"uncv",
        bytes(6),
        struct.pack(">H16xHHIIIH32sHh", 1, FRAME_SIDE, FRAME_SIDE, 72 << 16, 72 << 16, 0, 1, b"", 8, -1),
        *pixel,
    )
    last = frames - (chunks - 1) * FRAMES_PER_CHUNK
    runs = [(1, FRAMES_PER_CHUNK, 1)] if chunks > 1 else []
    if not runs or last != FRAMES_PER_CHUNK:
        runs.append((chunks, last, 1))

    keys = range(1, frames + 1, key_every)
    sync = [] if key_every == 1 else [_full(b"stss", 0, 0, struct.pack(">I", len(keys)), struct.pack(f">{len(keys)}I", *keys))]

    def moov(first: int) -> bytes:
        offsets = [first + i * FRAMES_PER_CHUNK * FRAME_BYTES for i in range(chunks)]
        wide = first + len(payload) >= 2**32
        table = _box(
            b"stbl",
            _full(b"stsd", 0, 0, struct.pack(">I", 1), entry),
            _full(b"stts", 0, 0, struct.pack(">III", 1, frames, 1)),
            *sync,
            _full(b"stsc", 0, 0, struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
            _full(b"stsz", 0, 0, struct.pack(">II", FRAME_BYTES, frames)),
            _full(b"co64" if wide else b"stco", 0, 0, struct.pack(">I", chunks), struct.pack(f">{chunks}{'Q' if wide else 'I'}", *offsets)),
        )
        handler = _full(b"hdlr", 0, 0, struct.pack(">I4s12x", 0, b"vide"), b"payload\0")
        links = _box(b"dinf", _full(b"dref", 0, 0, struct.pack(">I", 1), _full(b"url ", 0, 1)))
        media = _box(
            b"mdia",
            _full(b"mdhd", 0, 0, struct.pack(">IIIIHH", 0, 0, TIMESCALE, frames, 0x55C4, 0)),
            handler,
            _box(b"minf", _full(b"vmhd", 0, 1, bytes(8)), links, table),
        )
        track = _full(b"tkhd", 0, 3, struct.pack(">IIIII8xhhhH", 0, 0, 1, 0, frames, 0, 0, 0, 0), UNITY_MATRIX, struct.pack(">II", FRAME_SIDE << 16, FRAME_SIDE << 16))
        movie = _full(b"mvhd", 0, 0, struct.pack(">IIIIIH10x", 0, 0, TIMESCALE, frames, 0x10000, 0x0100), UNITY_MATRIX, bytes(24), struct.pack(">I", 2))
        return _box(b"moov", movie, _box(b"trak", track, media))

    data = _box(b"mdat", payload)
    head = len(data) - len(payload)
    size = len(moov(0))
    return ftyp + moov(len(ftyp) + size + head) + data


def walk(data: bytes) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """(the types of the box and up to seven boxes around it, body start, body stop) of every box, parents before children."""
    # a stack and not recursion: the depth is the file's
    stack: list[tuple[int, int, tuple[bytes, ...]]] = [(0, len(data), ())]
    while stack:
        start, stop, path = stack.pop()
        if start + 8 > stop:
            continue
        size, kind = struct.unpack_from(">I4s", data, start)
        head = 8
        if size == 1 and start + 16 <= stop:
            (size,) = struct.unpack_from(">Q", data, start + 8)
            head = 16
        elif size == 0:
            size = stop - start
        if size < head or start + size > stop:
            raise ValueError("a box does not fit into its parent")
        here = (*path[-7:], kind)
        yield here, start + head, start + size
        stack.append((start + size, stop, path))
        if kind in CONTAINERS:
            stack.append((start + head, start + size, here))


def _words(data: bytes, at: int, count: int, kind: str = ">u4") -> np.ndarray:
    if at + count * np.dtype(kind).itemsize > len(data):
        raise ValueError("a table ends too early")
    return np.frombuffer(data, kind, count, at).astype(np.int64)


def _sample_places(data: bytes, table: dict[bytes, tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Offset and size of every sample from the sample tables, after their claims are held against the file's length."""
    at = table[b"stsz"][0]
    same, count = struct.unpack_from(">II", data, at + 4)
    if same * count > len(data):
        raise ValueError("more sample bytes than the file has")
    if not same:
        sizes = _words(data, at + 12, count)
    wide = b"co64" in table
    at = table[b"co64" if wide else b"stco"][0]
    (chunks,) = struct.unpack_from(">I", data, at + 4)
    offsets = _words(data, at + 8, chunks, ">u8" if wide else ">u4")
    at = table[b"stsc"][0]
    (n,) = struct.unpack_from(">I", data, at + 4)
    runs = _words(data, at + 8, 3 * n).reshape(n, 3)
    held = np.diff(np.append(runs[:, 0], chunks + 1))
    if (held < 0).any() or (n and runs[0, 0] != 1) or int(sum(a * b for a, b in zip(held.tolist(), runs[:, 1].tolist(), strict=True))) != count:
        raise ValueError("the sample tables disagree")
    if same:
        sizes = np.full(count, same, np.int64)
    per_chunk = np.repeat(runs[:, 1], held)
    first = np.cumsum(per_chunk) - per_chunk
    before = np.cumsum(sizes) - sizes
    filled = np.flatnonzero(per_chunk)
    chunk_of = np.repeat(filled, per_chunk[filled])
    return offsets[chunk_of] + before - before[first[chunk_of]], sizes


def _tracks(data: bytes) -> list[dict[bytes, tuple[int, int]]]:
    """The places of each track's boxes by type; a file with fragments has none that can be read."""
    tracks: list[dict[bytes, tuple[int, int]]] = []
    for path, a, b in walk(data):
        if path[-1] == b"moof":
            raise ValueError("fragments are not supported")
        if path[-1] == b"trak":
            tracks.append({})
        if tracks and b"trak" in path:
            tracks[-1][path[-1]] = (a, b)
    return tracks


def read_container(data: bytes | None) -> dict | None:
    """Codec, geometry, duration and sample places of the first video track, else of the first; None for what cannot be read."""
    data = data or b""
    try:
        tracks = _tracks(data)
        video = [t for t in tracks if b"hdlr" in t and data[t[b"hdlr"][0] + 8 : t[b"hdlr"][0] + 12] == b"vide"]
        tables = (video or tracks)[0]
        at = tables[b"stsd"][0] + 8
        _, codec = struct.unpack_from(">I4s", data, at)
        width, height = struct.unpack_from(">HH", data, at + 32) if video else (None, None)
        at = tables[b"mdhd"][0]
        timescale, duration = struct.unpack_from(">IQ", data, at + 20) if data[at] else struct.unpack_from(">II", data, at + 12)
        offsets, sizes = _sample_places(data, tables)
        at = tables[b"stts"][0]
        (n,) = struct.unpack_from(">I", data, at + 4)
        runs = _words(data, at + 8, 2 * n).reshape(n, 2)
        if runs[:, 0].sum() != len(sizes):
            raise ValueError("the time table disagrees with the sizes")
        if b"stss" in tables:
            at = tables[b"stss"][0]
            (n,) = struct.unpack_from(">I", data, at + 4)
            keys = _words(data, at + 8, n) - 1
            if n and (keys[0] < 0 or keys[-1] >= len(sizes) or (np.diff(keys) <= 0).any()):
                raise ValueError("the table of key frames is out of order")
        else:  # without a sync table every sample is one
            keys = np.arange(len(sizes))
        if len(sizes) and (offsets.min() < 0 or (offsets + sizes).max() > len(data)):
            raise ValueError("a sample lies outside the file")
    except (KeyError, ValueError, struct.error, IndexError):
        return None
    return {
        "codec": codec.decode("latin-1"), "width": width, "height": height, "timescale": timescale, "duration": duration,
        "media_seconds": float((runs[:, 0] * runs[:, 1]).sum() / timescale) if timescale else None,
        "offsets": offsets, "sizes": sizes, "keys": keys,
    }


def merged_ranges(offsets: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """(offset, length) pairs with neighbours that touch joined."""
    if not len(offsets):
        return np.empty((0, 2), np.int64)
    new = np.append(True, offsets[1:] != offsets[:-1] + sizes[:-1])
    starts = np.flatnonzero(new)
    return np.stack([offsets[starts], np.add.reduceat(sizes, starts)], 1)


def stored_bytes(data: bytes, info: dict) -> bytes:
    """The sample bytes of a container in decoding order."""
    return b"".join(data[a : a + n] for a, n in merged_ranges(info["offsets"], info["sizes"]).tolist())


MEDIA_FIELDS = pa.schema([
    ("codec", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("duration_seconds", pa.float64()),
    ("n_samples", pa.int64()), ("n_keyframes", pa.int64()),
    ("keyframe_ranges", pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64())]))),
])
MEDIA_DDL = "codec string, width int, height int, duration_seconds double, n_samples long, n_keyframes long, keyframe_ranges array<struct<offset: long, length: long>>"


def media_columns(df: DataFrame, key: str, media: str) -> DataFrame:
    """(key, codec, width, height, duration_seconds, n_samples, n_keyframes, keyframe_ranges) of a binary column.

    Touching key frames share one range.  Null or malformed media give nulls.  Other columns of ``df`` are not
    read; join on ``key`` to get them back.
    """
    kind = dict(df.dtypes)[key]
    schema = MEDIA_FIELDS

    def rows(batches):
        for batch in batches:
            found = [read_container(x) for x in batch.column(1).to_pylist()]
            get = lambda f: [None if x is None else f(x) for x in found]
            columns = [
                get(lambda x: x["codec"]), get(lambda x: x["width"]), get(lambda x: x["height"]), get(lambda x: x["media_seconds"]),
                get(lambda x: len(x["sizes"])), get(lambda x: len(x["keys"])),
                get(lambda x: [{"offset": a, "length": n} for a, n in merged_ranges(x["offsets"][x["keys"]], x["sizes"][x["keys"]]).tolist()]),
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, f.type) for c, f in zip(columns, schema, strict=True))], names=[key, *schema.names])

    return df.select(key, media).mapInArrow(rows, f"`{key}` {kind}, {MEDIA_DDL}")


def payload_column(text: Column) -> Column:
    """UTF-8 bytes of a text; null counts as empty."""
    return F.encode(F.coalesce(text, F.lit("")), "utf-8")


def feature_of(media: bytes, info: dict) -> str:
    """What the sample tables say, and a checksum of the bytes in the key frames' ranges."""
    ranges = merged_ranges(info["offsets"][info["keys"]], info["sizes"][info["keys"]])
    crc = 0
    for a, n in ranges.tolist():
        crc = zlib.crc32(media[a : a + n], crc)
    table = hashlib.sha256(ranges.astype(">i8").tobytes()).hexdigest()[:16]
    return (
        f"codec={info['codec']};size={info['width']}x{info['height']};seconds={info['media_seconds']:.2f};samples={len(info['sizes'])}"
        f";keyframes={len(info['keys'])};ranges={len(ranges)}:{table};crc={crc:08x}"
    )


DIGEST = {
    "n_bytes": "long", "payload_bytes": "long", "payload_sha256": "string", "tail_crc32": "long", "media_bytes": "long", "media_sha256": "string", "feature": "string",
}


def _digest(ids: list, texts: list[str]) -> dict[str, list]:
    out: dict[str, list] = {f: [] for f in ("doc_id", *DIGEST)}
    for i, text in zip(ids, texts, strict=True):
        raw = text.encode()
        media = write_container(padded(raw))
        info = read_container(media)
        back = stored_bytes(media, info)
        row = (i, len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature_of(media, info))
        for name, value in zip(out, row, strict=True):
            out[name].append(value)
    return out


def media_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its text stored as a container and read back, with digests of both.

    Null and empty texts are one frame of padding; repeated rows give repeated rows; other columns are ignored.
    Ids that are no whole numbers are text and kept; an empty table gives an empty result.  One pass without a shuffle;
    a task holds one Arrow batch and one container, of a very long text the whole.
    """
    return map_documents(docs, _digest, DIGEST, id_col, text_col)


def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, media): every text stored losslessly as a container, for a binary column of a table."""

    def rows(ids, texts):
        return {"doc_id": ids, "media": [write_container(padded(t.encode())) for t in texts]}

    return map_documents(docs, rows, {"media": "binary"}, id_col, text_col)
