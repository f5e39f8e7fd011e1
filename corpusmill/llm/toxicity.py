"""Toxicity: a linear classifier with counterfactual regularisation.

Features are words and word beginnings with how often they occur (once, twice,
three times).  Their counts by label are summed over the labelled sample; all
that are significantly more frequent in toxic documents are kept, and so are all
identity terms, whatever their counts, for the penalty to act on.  The fit is a
logistic regression that also penalises score changes between counterfactuals:
a labelled sentence that names a group, against the same with every other term
of that row; and a sentence of each labelled document that names none, with
each term of a row added.  So naming a group, or which, does not move a score,
also where the labelled texts name none.  The squared changes are a quadratic
form of the weights, so only its sums travel, whatever the number of pairs.

Edge cases: whole texts are read, however long, once and in bounded batches; a null text is an empty one and gets the base score; without any
usable label every score is 0; repeated rows give repeated rows; columns other
than those named are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.plans.scratch import materialize, remove

from ._batches import chunks_of
from ._labels import fold_of, labelled_sample

MAX_LABELLED = 20_000  # labelled rows that a fit uses at most
MIN_DOCS = 5
MIN_RATIO = 3.84  # likelihood ratio of a feature: one in twenty by chance
LEVELS = 3
STEMS = range(3, 9)
RIDGE = 5e-4
SWAP_PENALTY = 10.0
STEPS, RATE = 300, 0.05
FOLDS, HELD = 4, 2
THRESHOLD = 0.3
MAX_MEMO = 400_000
WORD = re.compile(r"[^\W\d_]+")
SENTENCE = re.compile(r"[^.!?\n]+")

# Terms that name groups of people; each is swapped for all others of its row.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys", "transgender", "nonbinary"),
    ("woman", "man", "girl", "boy"),
    ("gay", "straight", "lesbian", "bisexual", "queer", "heterosexual"),
    ("black", "white", "asian", "latino", "indigenous"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic", "protestant"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics", "protestants"),
    ("african", "european", "american", "mexican", "chinese", "indian", "arab", "turkish", "polish", "russian"),
    ("immigrants", "refugees", "natives", "foreigners", "migrants"),
    ("old", "young", "elderly", "teenage"),
    ("blind", "deaf", "disabled", "autistic"),
    ("femmes", "hommes", "filles", "garçons"),
    ("musulmans", "chrétiens", "juifs", "hindous", "bouddhistes"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("muslime", "christen", "juden", "hindus", "buddhisten"),
    ("mujeres", "hombres", "chicas", "chicos"),
    ("musulmanes", "cristianos", "judíos", "hindúes", "budistas"),
)
PLACES = {term: (row, i) for row in reversed(IDENTITY_TERMS) for i, term in enumerate(row)}


def _code(name: str) -> int:
    """A 64-bit code whose last two bits are free for the level."""
    return int.from_bytes(hashlib.blake2b(name.encode(), digest_size=8).digest(), "little", signed=True) & ~3


class _Memo(dict):
    def __init__(self, compute):
        super().__init__()
        self.compute = compute

    def __missing__(self, key):
        if len(self) >= MAX_MEMO:
            self.clear()
        value = self[key] = self.compute(key)
        return value


def word_codes(word: str) -> tuple[int, ...]:
    """The word itself and its beginnings, as 64-bit codes."""
    return (_code("=" + word), *(_code(word[:k]) for k in STEMS if k < len(word)))


_WORDS = _Memo(word_codes)


def word_counts(words: list[str], codes) -> Counter:
    """How often each feature of ``codes[word]`` occurs."""
    counts: Counter = Counter()
    for word, n in Counter(words).items():
        for code in codes[word]:
            counts[code] += n
    return counts


def feature_codes(words: list[str]) -> set[int]:
    """The features of a text: each code plus 0, 1 or 2 for at least one, two or three occurrences."""
    return {code + k for code, n in word_counts(words, _WORDS).items() for k in range(min(n, LEVELS))}


def swapped_sentences(words: list[str]) -> list[list[str]]:
    """The versions of a sentence in which every identity term is the one so many places on in its row, for all distances."""
    rows = [PLACES[w][0] for w in words if w in PLACES]

    def moved(word: str, by: int) -> str:
        row, i = PLACES.get(word, ((word,), 0))
        return row[(i + by) % len(row)]

    return [[moved(w, by) for w in words] for by in range(1, max(map(len, rows), default=1))]


def counterfactuals(text: str) -> Iterator[tuple[set[int], set[int]]]:
    """The features of both sides of each pair of sentences that should have equal scores."""
    carrier, least = None, None
    for sentence in SENTENCE.finditer(text.lower()):
        words = WORD.findall(sentence[0])
        versions = swapped_sentences(words)
        if versions:
            own = feature_codes(words)
            yield from ((own, feature_codes(v)) for v in versions)
        elif words:
            mark = zlib.crc32(" ".join(words).encode())
            if least is None or mark < least:
                carrier, least = words, mark
    if carrier:
        row = IDENTITY_TERMS[least % len(IDENTITY_TERMS)]
        held = [feature_codes([*carrier, term]) for term in row]
        yield from ((held[0], other) for other in held[1:])


def identity_codes() -> set[int]:
    """The features of all identity terms as whole words."""
    return {word_codes(term)[0] + k for term in PLACES for k in range(LEVELS)}


COUNTS = pa.schema([("code", pa.int64()), ("toxic", pa.int64()), ("fine", pa.int64())])


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each label that hold a feature, summed for each chunk of texts."""
    for batch in batches:
        for part, texts in chunks_of(batch, 1, 4_000_000):
            tallies: tuple[Counter, Counter] = (Counter(), Counter())
            for label, text in zip(part.column(0).to_pylist(), texts, strict=True):
                tallies[label].update(feature_codes(WORD.findall(text.lower())))
            fine, toxic = tallies
            codes = list(fine.keys() | toxic.keys())
            yield pa.RecordBatch.from_arrays([pa.array(codes, pa.int64()), pa.array([toxic[c] for c in codes], pa.int64()), pa.array([fine[c] for c in codes], pa.int64())], schema=COUNTS)


def telling_features(sample: DataFrame, min_ratio: float = MIN_RATIO, min_docs: int = MIN_DOCS) -> list[int]:
    """The features that occur more in toxic documents, by the likelihood ratio of their counts; the sample bounds their number."""
    totals = sample.agg(F.sum("label"), F.count(F.lit(1))).first()
    toxic_docs, docs = float(totals[0] or 0), float(totals[1])
    if not 0 < toxic_docs < docs:
        return []
    fine_docs = docs - toxic_docs
    t, f = F.col("toxic"), F.col("fine")

    def term(seen, expected):
        return F.when(seen > 0, 2 * seen * F.log(seen / expected)).otherwise(F.lit(0.0))

    both = t + f
    ratio = (
        term(t, both * toxic_docs / docs)
        + term(f, both * fine_docs / docs)
        + term(toxic_docs - t, (docs - both) * toxic_docs / docs)
        + term(fine_docs - f, (docs - both) * fine_docs / docs)
    )
    counts = sample.select("label", "text").mapInArrow(_counts, "code long, toxic long, fine long").groupBy("code").agg(F.sum("toxic").alias("toxic"), F.sum("fine").alias("fine"))
    found = counts.filter((both >= min_docs) & (both < docs) & (t / toxic_docs > f / fine_docs)).filter(F.round(ratio, 6) >= min_ratio)
    return sorted(r.code for r in found.select("code").collect())


@dataclass
class ToxicityModel:
    """A bias and the weights of the kept features by code; how many pairs the fit used, and how many its features can tell apart."""

    bias: float
    weights: dict[int, float]
    pairs: int = 0
    telling_pairs: int = 0
    bases: set[int] = field(init=False, repr=False, compare=False)
    hits: _Memo = field(init=False, repr=False, compare=False)

    def __post_init__(self):
        self.bases = {code & ~3 for code in self.weights}
        self.hits = _Memo(self._hits)

    def __getstate__(self):
        return {"bias": self.bias, "weights": self.weights, "pairs": self.pairs, "telling_pairs": self.telling_pairs}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.__post_init__()

    def _hits(self, word: str) -> tuple[int, ...]:
        """The word's codes that have a weight at some level."""
        return tuple(c for c in word_codes(word) if c in self.bases)

    def score(self, text: str) -> float:
        counts = word_counts(WORD.findall(text.lower()), self.hits)
        total = self.bias
        for code in sorted(counts):
            for k in range(min(counts[code], LEVELS)):
                total += self.weights.get(code + k, 0.0)
        return float(1 / (1 + np.exp(-min(max(total, -40), 40))))


def fit_weights(indices: np.ndarray, lengths: np.ndarray, labels: np.ndarray, changes: dict[tuple[int, int], float], pairs: int, size: int, swap_penalty: float = SWAP_PENALTY) -> tuple[np.ndarray, float]:
    """Logistic weights and bias by full-batch Adam; row i holds the next ``lengths[i]`` features of ``indices``.

    The loss is the mean log loss, a ridge, and ``swap_penalty`` times the mean squared score change of the pairs, which
    is the quadratic form ``changes`` (both orders of a pair of features, or the square of one) over ``pairs``.
    """
    n, base = len(lengths), labels.mean()
    r, c = np.repeat(np.arange(n), lengths), indices
    left, right = (np.array([k[side] for k in changes], np.int64) for side in (0, 1))
    value = np.array(list(changes.values()), np.float64)
    x = np.append(np.zeros(size), np.log(base / (1 - base)))
    m, v = np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, STEPS + 1):
        z = np.bincount(r, x[c], minlength=n) + x[-1]
        error = (1 / (1 + np.exp(-z)) - labels) / n
        g = np.append(np.bincount(c, error[r], minlength=size) + RIDGE * x[:-1], error.sum())
        if pairs:
            g[:-1] += 2 * swap_penalty / pairs * np.bincount(left, value * x[right], minlength=size)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        x -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    return x[:-1], float(x[-1])


FOUND = pa.schema([("doc_id", pa.int64()), ("label", pa.int32()), ("features", pa.binary()), ("i", pa.int32()), ("j", pa.int32()), ("value", pa.float64()), ("pairs", pa.int64())])


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic", bound: int = MAX_LABELLED, swap_penalty: float = SWAP_PENALTY) -> ToxicityModel | None:
    """A model from at most ``bound`` labelled documents outside the held-out fold; None without both labels.

    What reaches the driver is bounded by the sample: ``bound`` lists of features as packed numbers, and the sums of the
    pairs' products by features of identity terms.
    """
    sample = materialize(labelled_sample(docs, labels, label, FOLDS, HELD, bound, id_col, text_col), "labelled")
    codes = telling_features(sample)
    if not codes:
        remove(sample)
        return None
    codes = sorted(identity_codes().union(codes))
    place = {code: i for i, code in enumerate(codes)}

    def kept(features: set[int]) -> list[int]:
        return sorted(place[c] for c in features if c in place)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: Counter = Counter()
        pairs = telling = 0
        for batch in batches:
            for part, texts in chunks_of(batch, 2):
                features = [np.array(kept(feature_codes(WORD.findall(t.lower()))), np.int32).tobytes() for t in texts]
                for text in texts:
                    for a, b in counterfactuals(text):
                        pairs += 1
                        signed = [(k, 1) for k in kept(a - b)] + [(k, -1) for k in kept(b - a)]
                        telling += bool(signed)
                        for i, x in signed:
                            for j, y in signed:
                                sums[i, j] += x * y
                none = [pa.nulls(len(part), f.type) for f in list(FOUND)[3:]]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), part.column(1).cast(pa.int32()), pa.array(features, pa.binary()), *none], schema=FOUND)
        if pairs:
            rows = [(i, j, float(x), None) for (i, j), x in sorted(sums.items())] + [(-1, -1, float(telling), pairs)]
            none = [pa.nulls(len(rows), f.type) for f in list(FOUND)[:3]]
            yield pa.RecordBatch.from_arrays([*none, *(pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), list(FOUND)[3:], strict=True))], schema=FOUND)

    ddl = "doc_id long, label int, features binary, i int, j int, value double, pairs long"
    both = materialize(sample.select("doc_id", "label", "text").mapInArrow(found, ddl), "features")
    rows = both.filter("label is not null").select("doc_id", "label", "features").toPandas().sort_values(["doc_id", "label"])
    lists = [np.frombuffer(f, np.int32) for f in rows.features]
    summed = both.filter("i is not null").groupBy("i", "j").agg(F.sum("value").alias("value"), F.sum("pairs").alias("pairs")).collect()
    total = next((r for r in summed if r.i < 0), None)
    changes = {(r.i, r.j): r.value for r in sorted(summed, key=lambda r: (r.i, r.j)) if r.i >= 0 and r.value}
    telling = int(total.value) if total else 0
    weights, bias = fit_weights(np.concatenate(lists).astype(np.int64), np.array([len(x) for x in lists]), rows.label.to_numpy(np.float64), changes, telling, len(codes), swap_penalty)
    remove(sample, both)
    return ToxicityModel(bias, {code: float(w) for code, w in zip(codes, weights, strict=True)}, int(total.pairs) if total else 0, telling)


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(doc_id, held_out, score, predicted, swap_pairs, telling_pairs) for every row; only the whole text decides the score.

    ``swap_pairs`` is how many counterfactual pairs the fit met, ``telling_pairs`` how many of them its features tell
    apart, so that they change the loss; the same numbers in all rows.
    """
    model = fit_toxicity(docs, labels, id_col, text_col, **options)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in chunks_of(batch, 1):
                scores = [0.0 if model is None else round(model.score(t), 9) for t in texts]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("doc_id"), text_col).mapInArrow(rows, f"doc_id {kind}, score double").select(
        "doc_id",
        F.coalesce(fold_of(F.col("doc_id"), FOLDS) == HELD, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
        F.lit(model.pairs if model else 0).cast("long").alias("swap_pairs"),
        F.lit(model.telling_pairs if model else 0).cast("long").alias("telling_pairs"),
    )
