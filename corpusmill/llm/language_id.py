"""Language identification: presence kernels over n-grams, Nystroem landmarks, ridge regression.

A text is the set of its character n-grams of one to four letters (lower case,
every other character a blank, none across two blanks): the blended spectrum.
The kernel of two texts counts the n-grams present in both, divided by the root
of the product of their numbers.  A few hundred labelled texts are landmarks; a
text's kernel values against them are its features, and for each language a
ridge regression tells it from the rest.  Every partition of the labelled sample
sums its part of the normal equations, the driver adds and solves them.

N-grams are known by a hash into 2^20 cells.  Texts are scored in batches: the
0/1 matrix of texts and cells times the matrix of cells and landmarks times the
weights, with the two right ones multiplied beforehand, so a batch costs one
sparse product of as many columns as there are languages.

Edge cases: a text that is null or has no letter is ``und`` with score 0, as is
every text when nothing can be learned; a null or empty id is never learned
from; of rows with one id the smallest (language, text) is learned; any text,
also of one letter, gets a language otherwise, ties the first by code point;
repeated rows give repeated rows; very long texts are read whole, a million
characters at a time; columns other than those named are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from corpusmill.plans.scratch import materialize

from ._batches import chunks_of
from ._labels import fold_of

MAX_LABELLED = 4_000  # labelled rows that a fit uses at most, about as many of each language
LANDMARKS = 256
ORDERS = 4
CELL_BITS = 20
RIDGE = 1e-3
FOLDS, HELD = 3, 1
WINDOW = 1_000_000
PARTS = 8
UNKNOWN = "und"

BASE, SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_MEMO: dict[str, np.ndarray] = {}


def _letters() -> np.ndarray:
    """True for every code point that is a letter."""
    if "letters" not in _MEMO:
        _MEMO["letters"] = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _MEMO["letters"]


def _distinct(cells: np.ndarray) -> np.ndarray:
    """The distinct numbers of an array below 2^20, in no order: each stays where it was written last."""
    if "last" not in _MEMO:
        _MEMO["last"] = np.zeros(1 << CELL_BITS, np.int32)
    last, turn = _MEMO["last"], np.arange(len(cells), dtype=np.int32)
    last[cells] = turn
    return cells[last[cells] == turn]


def _window_cells(text: str, first: bool, final: bool) -> np.ndarray | None:
    points = np.frombuffer(((" " if first else "") + text.lower() + (" " if final else "")).encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _letters()[points]
    if not letter.any():
        return None
    points = np.where(letter, points, 32).astype(np.uint64)
    apart = ~(letter[1:] | letter[:-1])  # two blanks in a row
    code, whole, found = points * BASE, letter, []
    for n in range(1, ORDERS + 1):
        if n > 1:
            code = code[:-1] * BASE + points[n - 1 :]
            whole = ~apart if n == 2 else whole[:-1] & ~apart[n - 2 :]
        found.append((((code + np.uint64(n)) * SPREAD) >> np.uint64(64 - CELL_BITS))[whole].astype(np.int32))
    return _distinct(np.concatenate(found))


def gram_cells(text: str) -> np.ndarray | None:
    """The distinct cells of a whole text's n-grams; None without a letter."""
    parts = []
    for start in range(0, max(len(text), 1), WINDOW):
        # windows overlap by what the longest n-gram reaches over
        part = _window_cells(text[start : start + WINDOW + ORDERS - 1], start == 0, start + WINDOW + ORDERS - 1 >= len(text))
        if part is not None:
            parts.append(part)
    if not parts:
        return None
    return parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))


class Landmarks:
    """The landmarks' cells, by cell: which of them hold it."""

    def __init__(self, cells: list[np.ndarray]):
        self.sizes = np.array([len(c) for c in cells], np.float64)
        owner = np.repeat(np.arange(len(cells), dtype=np.int32), [len(c) for c in cells])
        every = np.concatenate(cells)
        order = np.argsort(every, kind="stable")
        self.owner = owner[order]
        self.known, begins = np.unique(every[order], return_index=True)
        self.begins = np.append(begins, len(every))

    def rows(self, cells: np.ndarray) -> np.ndarray:
        """The places of ``cells`` among the known ones, without those that no landmark holds."""
        at = np.minimum(np.searchsorted(self.known, cells), len(self.known) - 1)
        return at[self.known[at] == cells]

    def kernel(self, cells: np.ndarray) -> np.ndarray:
        """The kernel values of a text against all landmarks."""
        at = self.rows(cells)
        begin, n = self.begins[at], self.begins[at + 1] - self.begins[at]
        place = np.repeat(begin - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
        shared = np.bincount(self.owner[place], minlength=len(self.sizes))
        return shared / np.sqrt(self.sizes * max(len(cells), 1))


@dataclass
class LanguageModel:
    """Languages in order, and for each cell its row of weights, one column for each language."""

    languages: list[str]
    place: np.ndarray
    weights: np.ndarray

    def scores(self, sets: list[np.ndarray]) -> np.ndarray:
        """(texts, languages): the batch's product."""
        sizes = np.array([len(s) for s in sets])
        held = self.weights[self.place[np.concatenate(sets)]]
        return np.add.reduceat(held, np.append(0, np.cumsum(sizes)[:-1]), axis=0, dtype=np.float64) / np.sqrt(sizes)[:, None]


def labelled_texts(docs: DataFrame, id_col: str, text_col: str, lang_col: str, bound: int) -> DataFrame:
    """(doc_id, lang, text, turn), at most ``bound`` rows outside the held-out fold, about as many of each language.

    Rows go by the hash of their id times the number of their language's rows, so rare languages come with all they
    have.  The chosen ids are few enough to broadcast.
    """
    usable = F.col(id_col).isNotNull() & F.col(lang_col).isNotNull() & F.coalesce(fold_of(F.col(id_col), FOLDS) != HELD, F.lit(False))
    rows = docs.filter(usable).select(F.col(id_col).alias("doc_id"), F.col(lang_col).cast("string").alias("lang"))
    counts = materialize(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "languages")
    share = F.pmod(F.xxhash64(F.lit("language"), "doc_id"), F.lit(1 << 40)) / (1 << 40)
    turned = rows.join(counts, "lang").select("doc_id", (share * F.col("n")).alias("turn"))
    chosen = turned.groupBy("doc_id").agg(F.min("turn").alias("turn")).orderBy("turn", "doc_id").limit(bound)
    texts = docs.filter(usable).select(F.col(id_col).alias("doc_id"), F.struct(F.col(lang_col).cast("string").alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).alias("it"))
    return texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "turn").agg(F.min("it").alias("it")).select("doc_id", "it.lang", "it.text", "turn")


def _cells_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, texts in chunks_of(batch, 2):
            cells = [gram_cells(t) for t in texts]
            kept = [i for i, c in enumerate(cells) if c is not None]
            lang, turn = (part.column(i).take(pa.array(kept, pa.int32())) for i in (1, 3))
            yield pa.RecordBatch.from_arrays([lang, turn, pa.array([cells[i] for i in kept], pa.list_(pa.int32()))], names=["lang", "turn", "cells"])


def _sums(marks: Landmarks, languages: list[str]):
    """Every partition's sums of ``kernel' kernel`` and ``kernel' targets`` as bytes."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = len(marks.sizes)
        a, b = np.zeros((m, m)), np.zeros((m, len(languages)))
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                k = np.array([marks.kernel(np.asarray(c, np.int32)) for c in part.column("cells").to_pylist()])
                y = np.where(np.array(part.column("lang").to_pylist())[:, None] == np.array(languages)[None, :], 1.0, -1.0)
                a, b = a + k.T @ k, b + k.T @ y
        yield pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in (a, b)], names=["a", "b"])

    return rows


def fit_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", bound: int = MAX_LABELLED, landmarks: int = LANDMARKS) -> LanguageModel | None:
    """A model from at most ``bound`` labelled documents outside the held-out fold; None without any.

    The driver gets the cells of ``landmarks`` texts and the sums of a fixed number of partitions.
    """
    sample = labelled_texts(docs, id_col, text_col, lang_col, bound).mapInArrow(_cells_of, "lang string, turn double, cells array<int>")
    sample = materialize(sample.repartition(PARTS, "turn"), "grams")
    first = sample.orderBy("turn", "lang", "cells").limit(landmarks).collect()
    if not first:
        return None
    languages = sorted(r.lang for r in sample.select("lang").distinct().collect())  # no more than the bounded sample has
    marks = Landmarks([np.array(r.cells, np.int32) for r in first])
    m = len(marks.sizes)
    a, b = np.zeros((m, m)), np.zeros((m, len(languages)))
    parts = sample.select("lang", "cells").mapInArrow(_sums(marks, languages), "a binary, b binary").collect()
    for row in sorted(parts, key=lambda r: bytes(r.b)):
        a += np.frombuffer(row.a).reshape(a.shape)
        b += np.frombuffer(row.b).reshape(b.shape)
    among = np.array([marks.kernel(np.array(r.cells, np.int32)) for r in first])
    alpha = np.linalg.lstsq(a + RIDGE * (among + among.T) / 2 + 1e-9 * np.eye(m), b, rcond=None)[0] / np.sqrt(marks.sizes)[:, None]
    # cells times landmarks times weights; the last row is of all cells that no landmark holds
    held = np.add.reduceat(alpha[marks.owner], marks.begins[:-1], axis=0)
    place = np.full(1 << CELL_BITS, len(held), np.int32)
    place[marks.known] = np.arange(len(held))
    return LanguageModel(languages, place, np.vstack([held, np.zeros((1, len(languages)))]).astype(np.float32))


def language_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row; only the whole text decides.

    The score is the winning regression's value, moved from -1..1 to 0..1 and cut there.  No shuffle of texts but of
    the sample's.
    """
    model = fit_languages(docs, id_col, text_col, lang_col, **options)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in chunks_of(batch, 0):
                sets = [gram_cells(t) if model else None for t in texts]
                known = [i for i, s in enumerate(sets) if s is not None]
                names, values = [UNKNOWN] * len(texts), np.zeros(len(texts))
                if known:
                    scores = model.scores([sets[i] for i in known])
                    best = scores.argmax(1)
                    values[known] = np.round(np.clip((scores[np.arange(len(known)), best] + 1) / 2, 0, 1), 9)
                    for i, place in zip(known, best.tolist(), strict=True):
                        names[i] = model.languages[place]
                yield pa.RecordBatch.from_arrays([part.column(1), pa.array(names, pa.string()), pa.array(values)], names=["doc_id", "lang_pred", "score"])

    columns = docs.select(F.col(text_col).alias("scored_text"), F.col(id_col).alias("doc_id"))
    schema = StructType([columns.schema["doc_id"], StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    scored = columns.mapInArrow(rows, schema)
    return scored.select("doc_id", F.coalesce(fold_of(F.col("doc_id"), FOLDS) == HELD, F.lit(False)).alias("held_out"), "lang_pred", "score")
