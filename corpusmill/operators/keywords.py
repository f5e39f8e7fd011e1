"""Tables of thousands of keywords, found in texts by their words or their rarest pieces.

A table of at most BROADCAST_KEYWORDS goes to every task, which looks through each different word of its texts once.  A
larger one is met piece by piece.

A keyword can occur only where each of its pieces of four characters does.  So for each keyword the piece is chosen that
the fewest texts hold (of the whole table of texts), and a text is compared with those keywords alone whose chosen piece
it holds.  The work follows the texts and the real candidates; a table of ten thousand keywords costs about what one of
ten does, where a condition for each keyword would cost a thousand times more.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from corpusmill.plans.scratch import materialize

PIECE = 4
BLOCK = 20_000  # pieces that a text is held against at once
BROADCAST_KEYWORDS = 100_000
KNOWN_WORDS, LONG_WORD = 100_000, 64  # words of texts, of so many characters at most, whose keywords a task remembers


def _pieces(chars: Column, size: int) -> Column:
    """All runs of ``size`` characters, each once; one character is looked at ``size`` times, however long the text."""

    def cut(c: Column) -> Column:
        starts = F.when(F.size(c) >= size, F.sequence(F.lit(0), F.size(c) - size)).otherwise(F.array().cast("array<int>"))
        return F.array_distinct(F.transform(starts, lambda i: F.concat(*(F.get(c, i + k) for k in range(size)))))

    # bound to a lambda's variable: else the optimizer would put the splitting of the text into every step
    return F.get(F.transform(F.array(chars), cut), F.lit(0))


def _keyword_pieces(words: DataFrame) -> DataFrame:
    """(keyword, size, piece): short keywords are their own only piece."""
    chars = F.split("keyword", "")
    size = F.least(F.size(chars), F.lit(PIECE))
    cut = F.coalesce(*(F.when(size == n, _pieces(chars, n)) for n in range(1, PIECE + 1)))
    return words.select("keyword", size.alias("size"), F.explode(cut).alias("piece"))


def _text_pieces(texts: DataFrame, sizes: list[int]) -> DataFrame:
    """``texts`` with ``own``, the different pieces of each text."""
    cut = texts.withColumn("chars", F.split("low", ""))
    return cut.withColumn("own", F.concat(*(_pieces(F.col("chars"), n) for n in sizes))).drop("chars")


def _held(texts: DataFrame, pieces: DataFrame, sizes: list[int], keep: list[str]) -> DataFrame:
    """(keep, piece): the pieces of ``pieces`` that each text holds, block by block of pieces."""
    # one row for each block; every block is looked up in every text's own pieces
    blocks = pieces.select("piece").distinct().withColumn("block", F.pmod(F.xxhash64("piece"), F.greatest(F.lit(1), F.lit(pieces.select("piece").distinct().count() // BLOCK + 1))))
    blocks = blocks.groupBy("block").agg(F.collect_list("piece").alias("wanted"))
    return _text_pieces(texts, sizes).join(blocks).select(*keep, F.explode(F.array_intersect("own", "wanted")).alias("piece"))


def _looked_up(id_col: str, words: list[str]):
    """Rows of (id, keyword) from (text_id, low): each different word of a text is looked through once a task, as texts share most of them.

    Keywords without blanks lie inside a word; those with blanks are looked for at every place of the text.
    """
    whole = {w for w in words if w.split() == [w]}
    spaced = set(words) - whole

    def held(text: str, table: set[str], sizes: list[int]) -> set[str]:
        return {cut for n in sizes for i in range(len(text) - n + 1) if (cut := text[i : i + n]) in table}

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes, spaced_sizes = sorted({len(w) for w in whole}), sorted({len(w) for w in spaced})
        known: dict[str, tuple] = {}
        for batch in batches:
            for part in (batch.slice(i, 64) for i in range(0, batch.num_rows, 64)):
                at, hits = [], []
                for i, text in enumerate(part.column(1).to_pylist()):
                    found = held(text, spaced, spaced_sizes)
                    for word in set(text.split()):
                        inside = known.get(word)
                        if inside is None:
                            inside = tuple(held(word, whole, sizes))
                            if len(word) <= LONG_WORD:
                                if len(known) >= KNOWN_WORDS:
                                    known.clear()
                                known[word] = inside
                        found.update(inside)
                    at += [i] * len(found)
                    hits += found
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at, pa.int64())), pa.array(hits, pa.string())], names=[id_col, "keyword"])

    return rows


def keyword_hits(texts: DataFrame, keywords: DataFrame, id_col: str, text_col: str, keyword_col: str = "keyword") -> DataFrame:
    """(id, keyword), once for each row of ``texts`` and each different keyword that its lower-cased text contains.

    Null and empty keywords, and those that hold upper case, occur nowhere; null texts hold none; rows with equal ids
    stay apart.  The keywords (of a large table, their pieces) are read when it is called, the hits are lazy.
    """
    words = keywords.select(F.col(keyword_col).alias("keyword")).filter("keyword <> '' and keyword = lower(keyword)").distinct()
    low = texts.select(F.col(id_col).alias("text_id"), F.lower(text_col).alias("low")).filter("low is not null")
    table = words.limit(BROADCAST_KEYWORDS + 1).collect()  # a table this small goes to every task
    if len(table) <= BROADCAST_KEYWORDS:
        kind = StructType([StructField(id_col, texts.schema[id_col].dataType), StructField("keyword", StringType())])
        return low.mapInArrow(_looked_up(id_col, [r.keyword for r in table]), kind)
    pieces = materialize(_keyword_pieces(words), "keyword-pieces")
    sizes = sorted(r["size"] for r in pieces.select("size").distinct().collect())  # four at most
    if not sizes:
        return low.select(F.col("text_id").alias(id_col), F.lit("").alias("keyword")).filter("false")
    # pieces are counted without their texts; whether the keywords' pieces are broadcast follows from their written size
    counts = _text_pieces(low, sizes).select(F.explode("own").alias("piece")).join(pieces.select("piece").distinct(), "piece").groupBy("piece").agg(F.count(F.lit(1)).alias("n"))
    rarest = pieces.join(counts, "piece", "left").groupBy("keyword").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col("piece"))).alias("best"))
    # a piece that no text holds: its keyword occurs nowhere
    chosen = materialize(rarest.filter("best.n > 0").groupBy(F.col("best.piece").alias("piece")).agg(F.collect_list("keyword").alias("keywords")), "keyword-anchors")
    candidates = _held(low, chosen, sizes, ["text_id", "low"])
    small = chosen.count() <= BROADCAST_KEYWORDS
    met = candidates.join(F.broadcast(chosen) if small else chosen, "piece")
    found = met.select(F.col("text_id").alias(id_col), F.explode(F.filter("keywords", lambda k: F.contains(F.col("low"), k))).alias("keyword"))
    return found


def first_labels(texts: DataFrame, table: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, label): for each different id the label of least ``rank`` of which a keyword occurs in a text; null without one.

    ``table`` has (rank, label, keyword); a keyword may stand under several labels.
    """
    hits = keyword_hits(texts, table, id_col, text_col).join(table.select("keyword", "rank", "label"), "keyword")
    first = hits.groupBy(id_col).agg(F.min(F.struct("rank", "label")).alias("it")).select(F.col(id_col).alias("_id"), F.col("it.label").alias("label"))
    ids = texts.select(id_col).distinct()
    return ids.join(first, F.col(id_col).eqNullSafe(F.col("_id")), "left").select(id_col, "label")
