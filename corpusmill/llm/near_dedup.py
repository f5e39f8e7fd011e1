"""Near-duplicate detection: DartMinHash signatures, banding, exact check.

A document is the set of its word shingles, or on demand (``weighted``) the
multiset: then a shingle's weight is how often it occurs, and similarity is the
weighted Jaccard.  DartMinHash throws darts, by hash alone, into the plane of
(element weight, rank): a Poisson process of rate one, drawn cell by cell.  A dart counts for a document when it lands inside the
element's weight, and for each coordinate the earliest dart is the signature:
two documents agree there with the probability of their weighted Jaccard
similarity.  Only cells up to the rank that fills all coordinates are drawn, so
sparse sets cost little more than their size.

Documents that share a band of coordinates are candidates.  Those that bands
connect are compared exactly, inside tasks that hold one or two blocks of them
and emit only links between texts not yet linked.  Where bands connect more
texts than GROUP_TEXTS, which chance links do at scale, the texts of each band
are compared instead, so no task follows the transitive closure.  In groups of
several blocks a few hubs go first, and texts that they have linked to the
largest class are not compared again with each other.  The classes are the
connected components of all links.

Edge cases: equal texts are one class whatever they hold; null counts as empty;
texts without words are like equal texts only; texts with fewer words than a
shingle are one shingle; ids may be null or repeat; an empty table gives an
empty result; columns other than the two named are ignored and may be of any
type.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType, VariantType

from corpusmill.operators.graph import components
from corpusmill.plans.scratch import materialize, remove

from ._batches import chunks_of

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 32, 5
BLOCK_TEXTS, BLOCK_CHARS = 256, 8_000_000
GROUP_TEXTS = 8_192
HUBS = 16
MAX_MEMO = 400_000
MAX_SEEN = 1_000_000
COLUMNS = 4_096

MIX_A, MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
# Poisson(1): the number of darts in a cell, by the quantile of a hash
DART_LIMITS = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(12)])


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input reaches every bit of the output."""
    x = (x ^ (x >> np.uint64(30))) * MIX_A
    x = (x ^ (x >> np.uint64(27))) * MIX_B
    return x ^ (x >> np.uint64(31))


def _unit(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(11)).astype(np.float64) * 2.0**-53


def darts(elements: np.ndarray, weights: np.ndarray, low: int, high: int, coordinates: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(coordinate, rank, dart) of all darts inside the weights with ranks in ``[low, high)``, for integer bounds.

    Every pair of a weight cell and a rank cell of an element holds a Poisson(1) number of darts that depend on the
    hash of element and cell only, so two documents see the same darts wherever both reach.
    """
    levels = np.maximum(1, np.ceil(weights)).astype(np.int64)
    owner = np.repeat(np.arange(len(elements)), levels)
    level = np.arange(len(owner)) - np.repeat(np.cumsum(levels) - levels, levels)
    span = high - low
    owner, level = np.repeat(owner, span), np.repeat(level, span)
    cell = np.tile(np.arange(low, high), len(owner) // max(span, 1))
    seed = mixed(elements[owner] + mixed(level.astype(np.uint64) << np.uint64(32) | cell.astype(np.uint64)))
    number = np.searchsorted(DART_LIMITS, _unit(seed), side="right")
    at = np.repeat(np.arange(len(seed)), number)
    which = np.arange(len(at)) - np.repeat(np.cumsum(number) - number, number)
    dart = mixed(seed[at] + (which.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    inside = level[at] + _unit(mixed(dart + np.uint64(1))) < weights[owner[at]]
    dart, at = dart[inside], at[inside]
    rank = cell[at] + _unit(mixed(dart + np.uint64(2)))
    coordinate = (mixed(dart + np.uint64(3)) % np.uint64(coordinates)).astype(np.int64)
    return coordinate, rank, dart


def signature(elements: np.ndarray, weights: np.ndarray, coordinates: int = BANDS * ROWS) -> np.ndarray:
    """The earliest dart in each coordinate; ``elements`` are distinct 64-bit hashes with positive weights."""
    reach = coordinates * (math.log(coordinates) + 4) / weights.sum()
    ends = reach if reach < 1 else math.ceil(reach)
    while True:
        coordinate, rank, dart = darts(elements, weights, 0, math.ceil(ends), coordinates)
        if ends < 1:
            near = rank < ends
            coordinate, rank, dart = coordinate[near], rank[near], dart[near]
        order = np.lexsort((rank, coordinate))
        coordinate, dart = coordinate[order], dart[order]
        first = np.flatnonzero(np.append(True, coordinate[1:] != coordinate[:-1])) if len(coordinate) else coordinate
        if len(first) == coordinates:
            return dart[first]
        ends = 2 * ends if ends < 0.5 else math.ceil(2 * ends)


def band_codes(marks: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """One 64-bit code for each band of a signature."""
    code = mixed(np.arange(1, bands + 1).astype(np.uint64))
    for column in marks.reshape(bands, -1).T:
        code = mixed(code * np.uint64(31) + column)
    return code


class _WordCodes(dict):
    """64-bit hashes of words, forgotten together when there are too many."""

    def __missing__(self, word: str) -> int:
        if len(self) >= MAX_MEMO:
            self.clear()
        value = self[word] = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
        return value


_CODES = _WordCodes()


def words_of(text: str) -> list[str]:
    return text.lower().split()


def shingle_codes(words: list[str], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The distinct 64-bit hashes of the shingles of a word list, and how often each occurs."""
    codes = np.array([_CODES[w] for w in words], np.uint64)
    if len(codes) < size:
        size = len(codes)
    out = np.zeros(len(codes) - size + 1, np.uint64)
    for i in range(size):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + codes[i : len(codes) - size + 1 + i])
    return np.unique(out, return_counts=True)


def element_codes(text: str, weighted: bool) -> np.ndarray:
    """The hashes whose plain Jaccard similarity is that of two texts; with weights, one for each occurrence by number."""
    words = words_of(text)
    if not words:
        return np.empty(0, np.uint64)
    codes, counts = shingle_codes(words)
    if not weighted:
        return codes
    number = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return mixed(np.repeat(codes, counts) + number.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _bands(weighted: bool):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            for part, texts in chunks_of(batch, 1):
                keys, codes = [], []
                for key, text in zip(part.column(0).to_pylist(), texts, strict=True):
                    if key in seen:
                        continue
                    if len(seen) >= MAX_SEEN:
                        seen.clear()
                    seen.add(key)
                    words = words_of(text)
                    if words:
                        elements, counts = shingle_codes(words)
                        keys.append(key)
                        codes.append(band_codes(signature(elements, counts.astype(np.float64) if weighted else np.ones(len(elements)))).view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(codes, pa.list_(pa.int64()))], names=["key", "bands"])

    return rows


def jaccard_links(sets: list[np.ndarray], left: range, right: range, threshold: float) -> list[tuple[int, int]]:
    """Pairs (i, j) of one of ``left`` and one of ``right`` with a similarity of at least ``threshold``: a forest that links all such pairs.

    ``sets`` hold distinct numbers each.  Intersections are products of 0/1 matrices over the elements that occur in at
    least two of the sets.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    _, place, used = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared_by = used > 1
    column = np.cumsum(shared_by) - 1
    kept = shared_by[place]
    owner, column = np.repeat(np.arange(len(sets)), sizes)[kept], column[place[kept]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    shared = np.zeros((len(left), len(right)), np.float32)
    width = int(shared_by.sum())
    for start in range(0, width, COLUMNS):
        a, b = np.searchsorted(column, (start, start + COLUMNS))
        m = np.zeros((len(sets), min(COLUMNS, width - start)), np.float32)
        m[owner[a:b], column[a:b] - start] = 1
        shared += m[left.start : left.stop] @ m[right.start : right.stop].T
    total = sizes[left.start : left.stop, None] + sizes[None, right.start : right.stop] - shared
    # exact in integers: shared / total >= threshold
    rows, columns = np.nonzero((shared >= threshold * total - 1e-6) & (shared > 0))
    parents, found = list(range(len(sets))), []

    def root(i: int) -> int:
        while parents[i] != i:
            parents[i] = parents[parents[i]]
            i = parents[i]
        return i

    for r, c in zip((rows + left.start).tolist(), (columns + right.start).tolist(), strict=True):
        x, y = root(r), root(c)
        if x != y:
            parents[max(x, y)] = min(x, y)
            found.append((r, c))
    return found


LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])
PLACE = ["kind", "grp", "x", "y"]


def _links(threshold: float, weighted: bool):
    def of_group(key: tuple, group: dict[int, tuple[int, np.ndarray]]) -> pa.RecordBatch:
        nodes = sorted(group, key=lambda n: (group[n][0], n))
        n, first = len(nodes), sum(block == key[2] for block, _ in group.values())
        left, right = (range(n), range(n)) if key[2] == key[3] else (range(first), range(first, n))
        found = jaccard_links([group[x][1] for x in nodes], left, right, threshold)
        ends = ([nodes[i] for i, _ in found], [nodes[j] for _, j in found])
        return pa.RecordBatch.from_arrays([pa.array(e, pa.int64()) for e in ends], schema=LINKS)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group = None, {}
        for batch in batches:
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True))
            blocks, nodes, texts = (batch.column(i) for i in (4, 5, 6))
            for here, block, node, text in zip(keys, blocks.to_pylist(), nodes.to_pylist(), texts, strict=True):
                if here != key:
                    if group:
                        yield of_group(key, group)
                    key, group = here, {}
                # numbers instead of words: eight bytes for a shingle
                group[node] = (block, element_codes(text.as_py(), weighted))
        if group:
            yield of_group(key, group)

    return rows


def _compared(dealt: DataFrame, texts: DataFrame, threshold: float, weighted: bool) -> DataFrame:
    """Links found in groups of (kind, grp, x, y): inside block x when x = y, else between the blocks x and y.

    Groups are dealt in ranges, so tasks get about equal numbers of rows and no group is cut.
    """
    met = dealt.join(texts, "node").select(*PLACE, "block", "node", "text")
    return met.repartitionByRange(*PLACE).sortWithinPartitions(*PLACE).mapInArrow(_links(threshold, weighted), "a long, b long")


def _block_count(n: str, chars: str) -> Column:
    """Blocks that hold at most about BLOCK_TEXTS texts and BLOCK_CHARS characters each."""
    return F.greatest(F.ceil(F.col(n) / BLOCK_TEXTS), F.ceil(F.col(chars) / BLOCK_CHARS), F.lit(1)).cast("int")


def _candidate_links(members: DataFrame, texts: DataFrame, threshold: float, weighted: bool) -> DataFrame:
    """Links that connect what is similar inside each group of ``members`` (kind, grp, node, chars).

    Groups of one block are compared whole.  In the others all texts first meet a few hubs, chosen by hash, which links
    a group of copies in linear time.  Then pairs of blocks are compared, except for pairs inside the largest class so
    far: only texts that are not in it meet all the others.
    """
    whole = ["kind", "grp"]
    sums = members.groupBy(*whole).agg(F.count(F.lit(1)).alias("n"), F.sum("chars").alias("all_chars"))
    sizes = materialize(sums.filter("n > 1").select(*whole, "n", _block_count("n", "all_chars").alias("blocks")), "groups")
    placed = members.join(sizes, whole)
    single = placed.filter("blocks = 1").select(*whole, F.lit(0).alias("x"), F.lit(0).alias("y"), F.lit(0).alias("block"), "node")
    large = materialize(placed.filter("blocks > 1").withColumn("block", (F.pmod(F.xxhash64("node"), F.col("blocks")) + 1).cast("int")), "large")
    # by hash alone, so no task ranks the members of a group: about HUBS of them
    is_hub = F.pmod(F.xxhash64(F.lit(1), "node"), F.col("n")) < HUBS
    hubs = large.filter(is_hub).withColumn("y", F.explode(F.sequence(F.lit(0), F.col("blocks")))).withColumns({"x": F.lit(0), "block": F.lit(0)})
    others = large.filter(~is_hub).withColumns({"x": F.lit(0), "y": F.col("block")})
    columns = [*PLACE, "block", "node"]
    first = materialize(_compared(single.unionByName(hubs.select(*columns)).unionByName(others.select(*columns)), texts, threshold, weighted), "links")
    if large.isEmpty():
        remove(sizes, large)
        return first

    classes = components(first).withColumnRenamed("component", "class_node")
    named = large.join(classes, "node", "left").withColumn("class_node", F.coalesce("class_node", "node"))
    named = materialize(named.select(*whole, "node", "chars", "class_node"), "named")
    remove(classes)
    counted = named.groupBy(*whole, "class_node").agg(F.count(F.lit(1)).alias("n"))
    largest = materialize(counted.groupBy(*whole).agg(F.max_by("class_node", "n").alias("main")), "main")
    sided = named.join(largest, whole).withColumn("linked", F.col("class_node") == F.col("main"))
    sided = materialize(sided.select(*whole, "node", "chars", "linked"), "sided")
    side = lambda linked, column: F.sum(F.when(F.col("linked") == linked, column).otherwise(F.lit(0)))
    sums = sided.groupBy(*whole).agg(
        side(False, F.lit(1)).alias("n_open"), side(False, F.col("chars")).alias("c_open"), side(True, F.lit(1)).alias("n_closed"), side(True, F.col("chars")).alias("c_closed")
    )
    parts = materialize(sums.filter("n_open > 0").select(*whole, _block_count("n_open", "c_open").alias("open"), _block_count("n_closed", "c_closed").alias("closed")), "parts")
    dealt = sided.join(parts, whole)
    # open blocks are numbered from 0, closed ones go on after them
    own = F.when(F.col("linked"), F.col("open") + F.pmod(F.xxhash64("node"), F.col("closed"))).otherwise(F.pmod(F.xxhash64("node"), F.col("open"))).cast("int")
    last = F.when(F.col("linked"), F.col("open")).otherwise(F.col("open") + F.col("closed")) - 1
    dealt = dealt.withColumn("block", own).withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    dealt = dealt.withColumns({"x": F.least("block", "other"), "y": F.greatest("block", "other")})
    links = materialize(first.unionByName(_compared(dealt.select(*columns), texts, threshold, weighted)), "links")
    remove(sizes, large, first, named, largest, sided, parts)
    return links


def _star_edges(held: DataFrame) -> DataFrame:
    """(a, b) that connect the same nodes as the bands do: each node, and each head of its bands, with the smallest of these heads."""
    least = held.groupBy("node").agg(F.min("head").alias("a"))
    heads = held.select("node", "head").join(least, "node").select("a", F.col("head").alias("b"))
    return least.select("a", F.col("node").alias("b")).union(heads).filter("a <> b").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, weighted: bool = False) -> DataFrame:
    """(doc_id, class_id, class_key, text_key, n_docs, n_texts), one row for every row of ``docs``.

    A class is a connected component of equal texts and of texts whose shingles have a Jaccard similarity of at least
    ``threshold``; ``class_id`` is its smallest doc_id.  With ``weighted``, shingles count as often as they occur.
    Pairs at 0.8 share a band with a probability of more than 0.999996.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("key", F.unhex(F.md5("text")))
    signed = materialize(rows.select("key", "text").mapInArrow(_bands(weighted), "key binary, bands array<long>"), "bands")
    members = materialize(rows.select("doc_id", "key"), "members")
    distinct = members.groupBy("key").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
    texts = materialize(distinct.withColumn("node", F.monotonically_increasing_id()), "texts")

    buckets = materialize(signed.join(texts, "key").select("node", F.explode("bands").alias("band")).distinct(), "buckets")
    heads = materialize(buckets.groupBy("band").agg(F.min("node").alias("head"), F.count(F.lit(1)).alias("held")).filter("held > 1").select("band", "head"), "heads")
    held = materialize(buckets.join(heads, "band"), "held")
    remove(signed, buckets, heads)
    connected = components(_star_edges(held))

    # one row for each text with candidates; the ids in the join's key spread the copies of one text
    wanted = connected.join(texts, "node").select("node", F.col("key").alias("its_key"), F.col("first_id").alias("its_id"))
    found = rows.join(wanted, (F.col("key") == F.col("its_key")) & F.col("doc_id").eqNullSafe(F.col("its_id")))
    found = materialize(found.select("node", "text").dropDuplicates(["node"]), "candidates")
    sizes = materialize(connected.groupBy("component").agg(F.count(F.lit(1)).alias("n")), "sizes")
    grouped = connected.join(sizes, "component").join(found.select("node", F.length("text").alias("chars")), "node")
    by_closure = grouped.filter(F.col("n") <= GROUP_TEXTS).select(F.lit(0).alias("kind"), F.col("component").alias("grp"), "node", "chars")
    by_band = grouped.filter(F.col("n") > GROUP_TEXTS).select("node", "chars").join(held, "node").select(F.lit(1).alias("kind"), F.col("band").alias("grp"), "node", "chars")
    dealt = materialize(by_closure.unionByName(by_band), "dealt")
    links = _candidate_links(dealt, found, threshold, weighted)
    remove(held, connected, found, sizes, dealt)

    linked = components(links).withColumnRenamed("component", "class_node")
    remove(links)
    together = linked.join(texts, "node").groupBy("class_node").agg(
        F.min("first_id").alias("class_id"), F.min("key").alias("class_key"), F.sum("copies").alias("all_docs"), F.count(F.lit(1)).alias("all_texts")
    )
    named = texts.join(linked.join(together, "class_node"), "node", "left")
    named = materialize(
        named.select(
            "key",
            F.when(F.col("class_key").isNull(), F.col("first_id")).otherwise(F.col("class_id")).alias("class_id"),
            F.lower(F.hex(F.coalesce("class_key", "key"))).alias("class_key"),
            F.coalesce("all_docs", "copies").alias("n_docs"),
            F.coalesce("all_texts", F.lit(1)).alias("n_texts"),
        ),
        "classes",
    )
    remove(linked, texts)
    return members.join(named, "key").select("doc_id", "class_id", "class_key", F.lower(F.hex("key")).alias("text_key"), "n_docs", "n_texts")


def _orderable(kind: DataType) -> bool:
    if isinstance(kind, ArrayType):
        return _orderable(kind.elementType)
    if isinstance(kind, StructType):
        return all(_orderable(f.dataType) for f in kind.fields)
    return not isinstance(kind, (MapType, VariantType))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, **options) -> DataFrame:
    """The documents without near duplicates: of each class one row with the smallest id, with the columns of ``docs``.

    The texts are shuffled once more, to meet the decisions; of rows that agree in id and text the first by their other
    columns stays (columns without an order, as maps, go by their JSON).
    """
    classes = near_duplicates(docs, id_col, text_col, threshold, **options)
    chosen = classes.groupBy("class_key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")).alias("it"))
    chosen = chosen.select(F.col("it.doc_id").alias("near_id"), F.col("it.text_key").alias("near_key"))
    # the row travels as one column, so its names clash with nothing
    names = [F.col(f"`{c}`") for c in docs.columns]
    keyed = docs.select(F.md5(F.coalesce(F.col(text_col), F.lit(""))).alias("text_key"), F.col(id_col).alias("its_id"), F.struct(*names).alias("row"))
    met = keyed.join(chosen, (F.col("text_key") == F.col("near_key")) & F.col("its_id").eqNullSafe(F.col("near_id")))
    other = [F.col("row").getField(f.name) if _orderable(f.dataType) else F.to_json(F.struct(F.col("row").getField(f.name))) for f in docs.schema if f.name != text_col]
    order = F.struct(*(c.alias(f"o{i}") for i, c in enumerate(other))) if other else F.lit(0)
    return met.groupBy("near_key").agg(F.min_by("row", order).alias("row")).select("row.*")
