"""Quality classifier: kernel ridge by random Fourier features over document statistics.

A text becomes a short vector of statistics (shares of character classes, word
and line shapes, repetition).  Cosines of random projections approximate a
Gaussian kernel on the standardised vectors; every partition of the labelled
sample sums its part of the normal equations, the driver adds and solves them.
A part of the sample that the fit has not seen calibrates the scores by
isotonic regression.

Edge cases: a null text is an empty one and gets a score like any other; ids
without labels are scored all the same; without any usable label every score is
0.5; repeated rows give repeated rows; columns other than those named are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from corpusmill.plans.scratch import materialize

from ._batches import chunks_of
from ._labels import fold_of, labelled_sample

MAX_LABELLED = 20_000  # labelled rows that a fit uses at most
FEATURES = 384
RIDGE = 1.0
SEED = 7
BINS = 2_048
FOLDS, HELD = 3, 1

LOWER, UPPER, LETTER, DIGIT, BLANK, BREAK, STOP, CALL, BAR, JUNK, OTHER = range(11)
STOPS = ".,;:?'\"()-"
JUNK_MARKS = "#$%&*+<>=@^~_\\/{}[]`"


def _classes() -> np.ndarray:
    table = np.full(0x10000, OTHER, np.int64)
    for code in range(0x10000):
        c = chr(code)
        if c.islower():
            table[code] = LOWER
        elif c.isupper():
            table[code] = UPPER
        elif c.isalpha():
            table[code] = LETTER
        elif c.isdigit():
            table[code] = DIGIT
        elif c == "\n":
            table[code] = BREAK
        elif c.isspace():
            table[code] = BLANK
    for marks, kind in ((STOPS, STOP), ("!", CALL), ("|", BAR), (JUNK_MARKS, JUNK)):
        for c in marks:
            table[ord(c)] = kind
    return table


_CLASSES: list[np.ndarray] = []
STATISTICS = 30


def statistics(text: str) -> list[float]:
    """The vector of a whole text; shares are between 0 and 1, sizes are logarithms."""
    if not _CLASSES:
        _CLASSES.append(_classes())
    points = np.frombuffer(text.encode("utf-32-le"), "<u4")
    share = np.bincount(_CLASSES[0][np.minimum(points, 0xFFFF)], minlength=11) / max(len(points), 1)
    words = text.split()
    n = max(len(words), 1)
    sizes = np.array([len(w) for w in words] or [0])
    seen = Counter(words)
    ends = Counter(w[-1] for w in words)
    pairs = len(set(zip(words, words[1:], strict=False)))
    lines = [x for x in text.split("\n") if x.strip()]
    raw = text.encode()
    return [
        *share.tolist(),
        float(np.log1p(len(points))),
        float(np.log1p(len(words))),
        float(sizes.mean()),
        float(sizes.std()),
        float((sizes <= 2).mean()),
        float((sizes > 12).mean()),
        len(seen) / n,
        max(seen.values(), default=0) / n,
        pairs / max(n - 1, 1),
        sum(w.isupper() and len(w) > 1 for w in words) / n,
        sum(w[:1].isupper() for w in words) / n,
        sum(k for c, k in ends.items() if c in JUNK_MARKS) / n,
        sum(k for c, k in ends.items() if c == "!") / n,
        seen["|"] / n,
        sum(any(c.isdigit() for c in w) for w in seen) / max(len(seen), 1),
        float(np.log1p(len(lines))),
        len(set(lines)) / max(len(lines), 1),
        float(np.log1p(np.mean([len(x) for x in lines]))) if lines else 0.0,
        len(zlib.compress(raw, 1)) / max(len(raw), 1),
    ]


@dataclass
class QualityModel:
    """Standardisation, projection, ridge weights and the calibration curve."""

    mean: np.ndarray
    scale: np.ndarray
    turns: np.ndarray
    shifts: np.ndarray
    weights: np.ndarray
    marks: np.ndarray
    levels: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.hstack([np.sqrt(2 / self.turns.shape[1]) * np.cos(z @ self.turns + self.shifts), np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated scores in 0..1, strictly increasing with the raw ones."""
        raw = self.raw(x)
        return 0.998 * np.interp(raw, self.marks, self.levels) + 0.002 / (1 + np.exp(-4 * (raw - 0.5)))


def isotonic(counts: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """The non-decreasing levels closest to ``ones / counts`` in weighted squares (pool adjacent violators)."""
    blocks: list[list[float]] = []
    for n, k in zip(counts.tolist(), ones.tolist(), strict=True):
        blocks.append([n, k, 1])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            n, k, size = blocks.pop()
            blocks[-1] = [blocks[-1][0] + n, blocks[-1][1] + k, blocks[-1][2] + size]
    return np.concatenate([np.full(size, k / n) for n, k, size in blocks]) if blocks else np.empty(0)


VECTORS = pa.schema([("doc_id", pa.int64()), ("label", pa.int32()), ("x", pa.list_(pa.float64()))])


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, texts in chunks_of(batch, 2):
            x = pa.array([statistics(t) for t in texts], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), part.column(1), x], schema=VECTORS)


def _matrix(column) -> np.ndarray:
    return np.array(column.to_pylist(), np.float64).reshape(len(column), STATISTICS)


SUMS = pa.schema([("a", pa.binary()), ("b", pa.binary())])


def _partial_sums(left, right_of):
    """Every partition's sums of ``features' features`` and ``features' label`` as bytes."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = b = None
        for batch in batches:
            f, y = left(_matrix(batch.column(1))), right_of(batch.column(0).to_numpy())
            a, b = (f.T @ f, f.T @ y) if a is None else (a + f.T @ f, b + f.T @ y)
        if a is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in (a, b)], schema=SUMS)

    return rows


def _added(df: DataFrame, features, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The sums of all partitions, added in a fixed order; their number is fixed, so what comes here is bounded."""
    parts = df.select("label", "x").mapInArrow(_partial_sums(features, lambda y: y.astype(np.float64)), "a binary, b binary").collect()
    a, b = np.zeros((order, order)), np.zeros(order)
    for row in sorted(parts, key=lambda r: bytes(r.b)):
        a += np.frombuffer(row.a).reshape(order, order)
        b += np.frombuffer(row.b)
    return a, b


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality", bound: int = MAX_LABELLED) -> QualityModel | None:
    """A model from at most ``bound`` labelled documents outside the held-out fold; None without both labels.

    Every fifth row by hash is left out of the fit and used for the calibration.
    """
    sample = labelled_sample(docs, labels, label, FOLDS, HELD, bound, id_col, text_col)
    sample = materialize(sample.mapInArrow(_vectors, "doc_id long, label int, x array<double>").repartition(8, "doc_id"), "vectors")
    calibrates = F.pmod(F.xxhash64(F.lit("calibration"), "doc_id"), F.lit(5)) == 0
    fit = sample.filter(~calibrates)

    moments, _ = _added(fit, lambda x: np.hstack([np.ones((len(x), 1)), x]), STATISTICS + 1)
    n = moments[0, 0]
    if n < 2:
        return None
    mean = moments[0, 1:] / n
    scale = np.sqrt(np.maximum(np.diag(moments)[1:] / n - mean**2, 1e-12))
    random = np.random.default_rng(SEED)
    model = QualityModel(mean, scale, random.standard_normal((STATISTICS, FEATURES)) / np.sqrt(STATISTICS), random.uniform(0, 2 * np.pi, FEATURES), np.zeros(FEATURES + 1), np.zeros(1), np.zeros(1))
    a, b = _added(fit, model.features, FEATURES + 1)
    if not 0 < b[-1] < n:
        return None
    model.weights = np.linalg.solve(a + RIDGE * np.eye(FEATURES + 1), b)

    def binned(batches):
        for batch in batches:
            raw = np.clip(model.raw(_matrix(batch.column(1))), -0.5, 1.5)
            at = np.minimum(((raw + 0.5) / 2 * BINS).astype(np.int64), BINS - 1)
            yield pa.RecordBatch.from_arrays([pa.array(at), batch.column(0).cast(pa.int64())], names=["bin", "label"])

    part = sample.filter(calibrates).select("label", "x").mapInArrow(binned, "bin long, label long")
    counts = part.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("k")).orderBy("bin").toPandas()
    if len(counts):
        at, n, k = (counts[c].to_numpy(np.float64) for c in ("bin", "n", "k"))
        model.marks, model.levels = (at + 0.5) / BINS * 2 - 0.5, isotonic(n, k)
    else:
        model.marks, model.levels = np.array([0.0, 1.0]), np.array([0.0, 1.0])
    return model


SCORES = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), **options) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row, and the columns in ``keep``.

    Only the whole text decides the score.  Two passes over the texts, the first over the labelled sample; no shuffle
    of texts.
    """
    model = fit_quality(docs, labels, id_col, text_col, **options)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in chunks_of(batch, 0):
                x = np.array([statistics(t) for t in texts]).reshape(len(texts), STATISTICS)
                scores = np.full(len(texts), 0.5) if model is None else np.round(model.score(x), 9)
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(scores)], names=[*batch.schema.names[1:], "score"])

    columns = docs.select(F.col(text_col).alias("scored_text"), F.col(id_col).alias("doc_id"), *(F.col(f"`{c}`").alias(f"kept_{i}") for i, c in enumerate(keep)))
    schema = StructType([*columns.schema.fields[1:], StructField("score", DoubleType())])
    return columns.mapInArrow(rows, schema).select(
        "doc_id",
        F.coalesce(fold_of(F.col("doc_id"), FOLDS) == HELD, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        *(F.col(f"kept_{i}").alias(c) for i, c in enumerate(keep)),
    )


def accepted_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents that the classifier does not reject, with the columns of ``docs``."""
    # the row travels as one column, so its names clash with nothing
    packed = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    scored = quality_scores(packed, labels.withColumnRenamed(id_col, "doc_id"), keep=("row",), **options)
    return scored.filter("predicted = 1").select("row.*")
