"""Document fingerprints from prefix polynomial hashes.

A text's prefix array holds the value of its polynomial at a fixed base, modulo
two primes, for every prefix.  Two lookups give the hash of any span, so spans
are compared without reading them, and the longest common extension of two
positions is found by binary search.  The fingerprint is the length, the hash
of the whole text, and a sketch: the span hashes of a fixed width, dealt into
bins, of which each keeps its smallest.

Edge cases: a null text is an empty one; rows with a null id come first; rows
with one id are ordered by their text; the row after the last is the first, so
a single row follows itself; repeated rows give repeated rows; ids that are no
whole numbers are text and kept as such; a very long text is held whole with its
successor, in arrays of 8 bytes for each code point; columns other than the two
named are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._batches import arrow_schema, ddl, map_documents, with_id

PRIMES = (2_147_483_647, 2_147_483_629)
BASES = (1_000_003, 998_244_353)
WIDTH = 12  # code points of the spans in a sketch
BINS = 128
EMPTY = 0xFFFFFFFF


class _Powers:
    """Powers of each base and of its inverse, as many as were asked for."""

    def __init__(self):
        self.up = self.down = [np.ones(1, np.uint64) for _ in PRIMES]

    def get(self, n: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
        if len(self.up[0]) < n:
            self.up = [_powers(b, m, 2 * n) for b, m in zip(BASES, PRIMES, strict=True)]
            self.down = [_powers(pow(b, -1, m), m, 2 * n) for b, m in zip(BASES, PRIMES, strict=True)]
        return self.up, self.down


def _powers(base: int, prime: int, n: int) -> np.ndarray:
    """The first ``n`` powers of ``base`` modulo ``prime``, by doubling."""
    out = np.ones(1, np.uint64)
    while len(out) < n:
        out = np.concatenate([out, out * np.uint64(pow(base, len(out), prime)) % np.uint64(prime)])
    return out[:n]


_POWERS = _Powers()


class PrefixHashes:
    """Prefix polynomial hashes of one text."""

    __slots__ = ("n", "sums")

    def __init__(self, n: int, sums: list[np.ndarray]):
        self.n, self.sums = n, sums

    @classmethod
    def of(cls, text: str) -> PrefixHashes:
        points = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64) + np.uint64(1)
        up, _ = _POWERS.get(len(points) + 1)
        zero = np.zeros(1, np.uint64)
        return cls(len(points), [np.concatenate([zero, np.cumsum(points * u[: len(points)] % np.uint64(m)) % np.uint64(m)]) for u, m in zip(up, PRIMES, strict=True)])

    def joined(self, keep: int, other: PrefixHashes, take: int) -> PrefixHashes:
        """The hashes of the first ``keep`` code points followed by the first ``take`` of another text."""
        up, _ = _POWERS.get(keep + take + 1)
        sums = [
            np.concatenate([a[: keep + 1], (a[keep] + u[keep] * b[1 : take + 1]) % np.uint64(m)])
            for a, b, u, m in zip(self.sums, other.sums, up, PRIMES, strict=True)
        ]
        return PrefixHashes(keep + take, sums)

    def spans(self, starts: np.ndarray, width) -> np.ndarray:
        """62-bit hashes of the spans that begin at ``starts``."""
        _, down = _POWERS.get(self.n + 1)
        first, second = (
            (s[starts + width] + np.uint64(m) - s[starts]) % np.uint64(m) * d[starts] % np.uint64(m) for s, d, m in zip(self.sums, down, PRIMES, strict=True)
        )
        return first << np.uint64(31) | second

    def span(self, start: int, width: int) -> int:
        return int(self.spans(np.array([start]), width)[0])

    def common(self, at: int, other: PrefixHashes, there: int) -> int:
        """The longest common extension: code points that agree from ``at`` here and ``there`` in ``other``."""
        low, high = 0, min(self.n - at, other.n - there)
        while low < high:
            middle = (low + high + 1) // 2
            if self.span(at, middle) == other.span(there, middle):
                low = middle
            else:
                high = middle - 1
        return low

    def whole(self) -> int:
        return self.span(0, self.n)

    def sketch(self) -> np.ndarray:
        """The smallest mixed span hash in each bin (32 bits); bins without a span hold EMPTY."""
        out = np.full(BINS, EMPTY, np.uint32)
        if not self.n:
            return out
        width = min(WIDTH, self.n)
        h = self.spans(np.arange(self.n - width + 1), width)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        h = np.sort(h ^ (h >> np.uint64(31)))
        bins = (h >> np.uint64(57)).astype(np.int64)
        first = np.flatnonzero(np.append(True, bins[1:] != bins[:-1]))
        out[bins[first]] = np.minimum(h[first] >> np.uint64(25) & np.uint64(EMPTY), np.uint64(EMPTY - 1))
        return out


def fingerprint(hashes: PrefixHashes, sketch: np.ndarray) -> str:
    """Length (8 hex digits), hash of the whole text (16), then the sketch's bins (8 each)."""
    return f"{hashes.n:08x}{hashes.whole():016x}" + sketch.astype(">u4").tobytes().hex()


def likeness(a: str, b: str) -> float:
    """The share of spans that two texts have in common (Dice), estimated from their fingerprints alone."""
    if a == b:
        return 1.0
    x, y = (np.frombuffer(bytes.fromhex(f[24:]), ">u4") for f in (a, b))
    used = ((x != EMPTY) | (y != EMPTY)).sum()
    if not used:
        return 0.0
    shared = ((x == y) & (x != EMPTY)).sum() / used
    return float(2 * shared / (1 + shared))


KEY = 32  # characters of a text that tell rows of one id apart when blocks are cut


def _key(doc_id, head: str | None) -> tuple:
    return (doc_id is not None, doc_id if doc_id is not None else 0, head is not None, head or "")


def _block_firsts(keys: DataFrame, parts: int) -> list[tuple]:
    """The least (doc_id, head) of each of at most ``parts`` blocks, in order, from a range sort of the keys."""
    dealt = keys.repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), F.col("head").asc_nulls_first())
    least = dealt.groupBy(F.spark_partition_id().alias("at")).agg(F.min(F.struct("doc_id", "head")).alias("least"))
    return sorted(_key(r.least.doc_id, r.least["head"]) for r in least.collect())


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(block, guest, doc_id, text), dealt by blocks and sorted: in each block every row is followed by its successor.

    Blocks are ranges of ids, and of the beginnings of texts among rows of one id or without any, so these share a task
    only if both agree.  The first row of each block is also sent, as a guest, to the end of the block before (of the
    first block: to the last).  There are at most four blocks for each shuffle partition, whatever the number of rows,
    and only their first keys reach the driver, when this is called.  The texts are shuffled once.
    """
    spark = docs.sparkSession
    rows = docs.select(with_id(docs, id_col), F.col(text_col).alias("text")).withColumn("head", F.substring("text", 1, KEY))
    firsts = _block_firsts(rows.select("doc_id", "head"), 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    n = max(1, len(firsts))

    @F.arrow_udf("struct<block: long, least: boolean>")
    def place(doc_id: pa.Array, head: pa.Array) -> pa.Array:
        keys = [_key(i, h) for i, h in zip(doc_id.to_pylist(), head.to_pylist(), strict=True)]
        at = [bisect_right(firsts, k) - 1 for k in keys]
        return pa.StructArray.from_arrays([pa.array(at, pa.int64()), pa.array([firsts[b] == k for b, k in zip(at, keys, strict=True)], pa.bool_())], ["block", "least"])

    placed = rows.withColumn("place", place("doc_id", "head"))
    guests = placed.filter("place.least").groupBy("place.block").agg(F.min(F.struct("doc_id", "text")).alias("it"))
    guests = guests.select(F.pmod(F.col("block") - 1, F.lit(n)).alias("block"), F.lit(True).alias("guest"), "it.doc_id", "it.text")
    own = placed.select("place.block", F.lit(False).alias("guest"), "doc_id", "text")
    return own.unionByName(guests).repartition("block").sortWithinPartitions("block", "guest", F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())


OUT = {
    "doc_id": "long", "n_chars": "long", "edited_sha256": "string", "fingerprint": "string", "edited_fingerprint": "string",
    "near_edited": "double", "near_next": "double", "common_edited": "long", "common_next": "long",
}
BATCH = 500


class _Seen:
    """A text with what is computed of it once, as a document and as the one after."""

    def __init__(self, doc_id, text: str):
        self.id, self.text = doc_id, text
        self.hashes = PrefixHashes.of(text)
        self.print = fingerprint(self.hashes, self.hashes.sketch())


def _compare(this: _Seen, after: _Seen) -> tuple:
    n = len(this.text)
    half = n // 2
    keep, take = n - half, min(half, len(after.text))
    edited = this.hashes.joined(keep, after.hashes, take)
    edited_print = fingerprint(edited, edited.sketch())
    digest = hashlib.sha256((this.text[:keep] + after.text[:take]).encode()).hexdigest()
    return (
        this.id, n, digest, this.print, edited_print, likeness(this.print, edited_print), likeness(this.print, after.print),
        this.hashes.common(0, edited, 0), this.hashes.common(0, after.hashes, 0),
    )


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The compared rows of a partition, in order; one text and its successor are held at a time."""
    block, this, closed = None, None, False
    for batch in batches:
        for row in range(batch.num_rows):
            b, guest, doc_id, text = (batch.column(i)[row].as_py() for i in range(4))
            if b != block:
                block, this, closed = b, None, False
            if closed:
                continue
            here = _Seen(doc_id, text or "")
            if this is not None:
                yield _compare(this, here)
            this, closed = here, guest


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every whole text and of its edit, with their likeness.

    The edit replaces the last ``floor(n_chars / 2)`` code points by as many (or all) of the first of the document
    with the next id.  ``near_edited`` and ``near_next`` come from the fingerprints alone; ``common_edited`` and
    ``common_next`` are longest common extensions from the start, in code points.  The keys of the blocks are sorted when
    it is called (:func:`with_next`); everything else is lazy.
    """
    rows = with_next(docs, id_col, text_col)
    own = OUT | {"doc_id": rows.schema["doc_id"].dataType.simpleString()}
    schema = arrow_schema(own)

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = _pairs(batches)
        while held := list(islice(pairs, BATCH)):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)

    return rows.mapInArrow(compared, ddl(own))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint) of every whole text, in one pass without a shuffle."""

    def rows(ids, texts):
        return {"doc_id": ids, "fingerprint": [_Seen(i, t).print for i, t in zip(ids, texts, strict=True)]}

    return map_documents(docs, rows, {"fingerprint": "string"}, id_col, text_col)
