"""Bounded-size text batches for the Python operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_CHARS = 1_000_000


def text_chunks(lengths: list[int], max_chars: int = MAX_CHARS) -> Iterator[tuple[int, int]]:
    """Row ranges ``[start, stop)`` whose texts hold about ``max_chars`` code points together.

    A single longer text is a range of its own, so the memory needed follows the longest text
    and not the number of rows.
    """
    start, held = 0, 0
    for i, n in enumerate(lengths):
        if i > start and held + n > max_chars:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(lengths):
        yield start, len(lengths)


def chunks_of(batch: pa.RecordBatch, text: int, max_chars: int = MAX_CHARS) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of a batch with their texts as Python strings, null as empty; no more of a batch is turned into objects at once."""
    lengths = pc.fill_null(pc.utf8_length(batch.column(text)), 0).to_pylist()
    for a, b in text_chunks(lengths, max_chars):
        part = batch.slice(a, b - a)
        yield part, [t or "" for t in part.column(text).to_pylist()]


def map_texts(rows: Callable[[list, list[str]], dict[str, list]], schema: pa.Schema, max_chars: int = MAX_CHARS):
    """A ``mapInArrow`` function over columns (key, text): nulls become empty texts.

    ``rows(keys, texts)`` returns the output columns for one bounded chunk.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in chunks_of(batch, 1, max_chars):
                out = rows(part.column(0).to_pylist(), texts)
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in schema], schema=schema)

    return run


ARROW = {
    "long": pa.int64(), "bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32()),
}


def with_id(docs: DataFrame, id_col: str) -> Column:
    """The id as ``doc_id``: whole numbers as long, everything else as text, so no id is lost."""
    whole = isinstance(docs.schema[id_col].dataType, T.ByteType | T.ShortType | T.IntegerType | T.LongType)
    return F.col(id_col).cast("long" if whole else "string").alias("doc_id")


def arrow_schema(columns: dict[str, str]) -> pa.Schema:
    return pa.schema([(name, ARROW[kind]) for name, kind in columns.items()])


def ddl(columns: dict[str, str]) -> str:
    return ", ".join(f"{name} {kind}" for name, kind in columns.items())


def map_documents(docs: DataFrame, rows, columns: dict[str, str], id_col: str = "doc_id", text_col: str = "text", max_chars: int = MAX_CHARS) -> DataFrame:
    """``rows(ids, texts)`` of bounded chunks of the documents, as (doc_id, columns); ids as :func:`with_id` gives them."""
    named = docs.select(with_id(docs, id_col), text_col)
    own = {"doc_id": named.schema["doc_id"].dataType.simpleString()} | columns
    return named.mapInArrow(map_texts(rows, arrow_schema(own), max_chars), ddl(own))
