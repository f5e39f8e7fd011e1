"""Answer heads over sets of panel vectors: mean pooling, and question-conditioned set attention.

:func:`train_heads_on_all` fits pooling and heads together on all rows, by synchronous steps whose gradients the
partitions sum.  :func:`train_heads` fits pooling and heads together, with the gradients written out in numpy, on a bounded sample of the
training rows, and predicts in Arrow batches.  :func:`fit_heads` is its distributed, linear counterpart: all rows train one
linear softmax head for each question type with Spark ML, over representations whose attention stays random.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from corpusmill.operators.sampling import sample_n
from corpusmill.plans.scratch import materialize

MAX_PANELS = 32


def pad_sets(sets: list[list[list[float]]], width: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Vectors padded with zeros to the longest set, and a mask that is true where nothing is.

    ``width`` is that of the vectors, for when all sets may be empty.
    """
    most = max((len(s) for s in sets), default=0) or 1  # one empty place where all sets are empty
    width = next((len(v) for s in sets for v in s), 0) if width is None else width
    panels, empty = np.zeros((len(sets), most, width)), np.ones((len(sets), most), bool)
    for i, s in enumerate(sets):
        if s:
            panels[i, : len(s)], empty[i, : len(s)] = s, False
    return panels, empty


def mean_pool(panels: np.ndarray, question: np.ndarray, empty: np.ndarray) -> np.ndarray:
    """The mean of each set's vectors, then the question; the order of a set does not matter."""
    held = ~empty[..., None]
    return np.concatenate([(panels * held).sum(1) / np.maximum(held.sum(1), 1), question], axis=1)


class SetAttention:
    """Position-aware self-attention over a set, pooled by attention to the question.

    ``weights`` are random until :func:`train_attention` has fitted them.
    """

    def __init__(self, width: int, heads: int = 2, seed: int = 42):
        rng = np.random.default_rng(seed)
        self.heads = heads if width % heads == 0 else 1
        self.weights = {"position": rng.normal(size=(MAX_PANELS, width))}
        self.weights |= {name: rng.normal(scale=width**-0.5, size=(width, width)) for name in ("query", "key", "value", "out", "ask")}

    def _split(self, x: np.ndarray) -> np.ndarray:
        return x.reshape(*x.shape[:2], self.heads, -1).transpose(0, 2, 1, 3)

    def _merge(self, x: np.ndarray) -> np.ndarray:
        return x.transpose(0, 2, 1, 3).reshape(x.shape[0], x.shape[2], -1)

    def _steps(self, panels: np.ndarray, question: np.ndarray, empty: np.ndarray) -> tuple[np.ndarray, ...]:
        w = self.weights
        tokens = panels + w["position"][None, : panels.shape[1]]
        q, k, v = (self._split(tokens @ w[name]) for name in ("query", "key", "value"))
        share = _softmax(q @ k.transpose(0, 1, 3, 2) / np.sqrt(q.shape[-1]), empty[:, None, None, :])
        mixed = self._merge(share @ v)
        attended, asked = mixed @ w["out"], question @ w["ask"]
        weight = _softmax((attended * asked[:, None, :]).sum(-1), empty)
        return tokens, q, k, v, share, mixed, attended, asked, weight

    def __call__(self, panels: np.ndarray, question: np.ndarray, empty: np.ndarray) -> np.ndarray:
        *_, attended, _, weight = self._steps(panels, question, empty)
        return np.concatenate([(weight[..., None] * attended).sum(1), question], axis=1)

    def gradients(self, panels: np.ndarray, question: np.ndarray, empty: np.ndarray, pooled: np.ndarray) -> dict[str, np.ndarray]:
        """The loss's gradient by each weight, from its gradient ``pooled`` by the pooled vectors (without the question)."""
        w = self.weights
        tokens, q, k, v, share, mixed, attended, asked, weight = self._steps(panels, question, empty)
        by_weight = (attended * pooled[:, None, :]).sum(-1)
        by_score = weight * (by_weight - (weight * by_weight).sum(-1, keepdims=True))
        by_attended = weight[..., None] * pooled[:, None, :] + by_score[..., None] * asked[:, None, :]
        by_heads = self._split(by_attended @ w["out"].T)
        by_share = by_heads @ v.transpose(0, 1, 3, 2)
        by_logit = share * (by_share - (share * by_share).sum(-1, keepdims=True)) / np.sqrt(q.shape[-1])
        by_parts = {"query": by_logit @ k, "key": by_logit.transpose(0, 1, 3, 2) @ q, "value": share.transpose(0, 1, 3, 2) @ by_heads}
        by_parts = {name: self._merge(g) for name, g in by_parts.items()}
        out = {name: np.einsum("nmi,nmj->ij", tokens, g) for name, g in by_parts.items()}
        out["out"] = np.einsum("nmi,nmj->ij", mixed, by_attended)
        out["ask"] = question.T @ (by_score[..., None] * attended).sum(1)
        out["position"] = np.zeros_like(w["position"])
        out["position"][: panels.shape[1]] = sum(g @ w[name].T for name, g in by_parts.items()).sum(0)
        return out


def _softmax(scores: np.ndarray, empty: np.ndarray) -> np.ndarray:
    """Along the last axis, with zero weight for empty places; all zero for an empty set."""
    scores = np.where(empty, -np.inf, scores)
    top = np.where(np.isfinite(scores.max(-1, keepdims=True)), scores.max(-1, keepdims=True), 0)
    e = np.exp(scores - top)
    return e / np.maximum(e.sum(-1, keepdims=True), 1e-300)


class Network:
    """Pooled sets with one head of two layers for each question type; all weights are fitted together.

    In mode "mean" the pooling has no weights, in mode "attention" it is a :class:`SetAttention`.
    """

    def __init__(self, width: int, spaces: dict[str, list[str]], mode: str = "attention", hidden: int = 128, seed: int = 42):
        if mode not in ("mean", "attention"):
            raise ValueError(mode)
        rng = np.random.default_rng(seed)
        self.spaces, self.pool = spaces, SetAttention(width, seed=seed) if mode == "attention" else None
        self.weights = {}
        for kind, answers in spaces.items():
            self.weights[kind, "in"] = rng.normal(scale=(2 * width) ** -0.5, size=(2 * width, hidden))
            self.weights[kind, "in_bias"] = np.zeros(hidden)
            self.weights[kind, "out"] = rng.normal(scale=hidden**-0.5, size=(hidden, len(answers)))
            self.weights[kind, "out_bias"] = np.zeros(len(answers))
        if self.pool:
            # the pooling's weights under names of their own, the same arrays
            self.weights |= {("pool", name): w for name, w in self.pool.weights.items()}

    def _head(self, kind: str, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        inner = np.maximum(x @ self.weights[kind, "in"] + self.weights[kind, "in_bias"], 0)
        logits = inner @ self.weights[kind, "out"] + self.weights[kind, "out_bias"]
        return inner, _softmax(logits, np.zeros(logits.shape, bool))

    def predict(self, panels: np.ndarray, question: np.ndarray, empty: np.ndarray, kinds: list[str]) -> list[str | None]:
        """Each row's likeliest answer; null for a type that was not trained."""
        x = (self.pool or mean_pool)(panels, question, empty)
        out: list[str | None] = [None] * len(kinds)
        for kind, answers in self.spaces.items():
            at = [i for i, k in enumerate(kinds) if k == kind]
            if at:
                for i, best in zip(at, self._head(kind, x[at])[1].argmax(1), strict=True):
                    out[i] = answers[best]
        return out

    def loss(self, panels: np.ndarray, question: np.ndarray, empty: np.ndarray, kinds: np.ndarray, labels: np.ndarray) -> tuple[float, dict]:
        """The mean cross entropy of the rows, and its gradient by each weight."""
        x = (self.pool or mean_pool)(panels, question, empty)
        by_x, total, out = np.zeros_like(x), 0.0, {name: np.zeros_like(w) for name, w in self.weights.items()}
        for kind in self.spaces:
            at = np.flatnonzero(kinds == kind)
            if not len(at):
                continue
            inner, chance = self._head(kind, x[at])
            truth = (np.arange(len(at)), labels[at])
            total -= np.log(np.maximum(chance[truth], 1e-300)).sum() / len(kinds)
            by_logit = chance.copy()
            by_logit[truth] -= 1
            by_logit /= len(kinds)
            by_inner = (by_logit @ self.weights[kind, "out"].T) * (inner > 0)
            out[kind, "in"], out[kind, "in_bias"] = x[at].T @ by_inner, by_inner.sum(0)
            out[kind, "out"], out[kind, "out_bias"] = inner.T @ by_logit, by_logit.sum(0)
            by_x[at] = by_inner @ self.weights[kind, "in"].T
        if self.pool:
            pooled = by_x[:, : panels.shape[2]]
            out |= {("pool", name): g for name, g in self.pool.gradients(panels, question, empty, pooled).items()}
        return total, out


def train_network(rows: list[tuple[str, str, list, list]], mode: str = "attention", hidden: int = 128, epochs: int = 30, batch: int = 32, rate: float = 1e-3, decay: float = 1e-4, seed: int = 42) -> Network | None:
    """A network fitted on rows of (question type, answer, panels, question vector) by Adam with decoupled weight decay."""
    spaces: dict[str, list[str]] = {kind: sorted({r[1] for r in rows if r[0] == kind}) for kind in sorted({r[0] for r in rows})}
    width = max((len(r[3]) for r in rows), default=0)
    if not width:
        return None
    network, rng = Network(width, spaces, mode, hidden, seed), np.random.default_rng(seed)
    kinds, labels = np.array([r[0] for r in rows]), np.array([spaces[r[0]].index(r[1]) for r in rows])
    adam = _Adam(network.weights, rate, decay)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in np.split(order, range(batch, len(rows), batch)):
            panels, empty = pad_sets([rows[i][2] for i in at], width)
            _, by = network.loss(panels, np.array([rows[i][3] for i in at]), empty, kinds[at], labels[at])
            adam.move(by)
    return network


class _Adam:
    """Adam with decoupled weight decay, in place, as the pooling holds the same arrays."""

    def __init__(self, weights: dict, rate: float, decay: float):
        self.weights, self.rate, self.decay, self.step = weights, rate, decay, 0
        self.means, self.squares = ({name: np.zeros_like(w) for name, w in weights.items()} for _ in range(2))

    def move(self, by: dict) -> None:
        self.step += 1
        for name, w in self.weights.items():
            self.means[name] += 0.1 * (by[name] - self.means[name])
            self.squares[name] += 0.001 * (by[name] ** 2 - self.squares[name])
            moved = self.means[name] / (1 - 0.9**self.step) / (np.sqrt(self.squares[name] / (1 - 0.999**self.step)) + 1e-8)
            w -= self.rate * (moved + self.decay * w)


def _trainable() -> Column:
    usable = F.col("question_type").isNotNull() & F.col("question_vector").isNotNull() & (F.coalesce(F.size("panels"), F.lit(0)) <= MAX_PANELS)
    return F.coalesce(usable, F.lit(False))


def _sample_rows(batch: pa.RecordBatch, at: list[int], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Padded panels, question vectors and mask of some rows of (.., panels, question_vector) at columns 2 and 3."""
    part = batch.take(pa.array(at, pa.int64()))
    counts = pc.fill_null(pc.list_value_length(part.column(2)), 0).to_numpy(zero_copy_only=False)
    flat = part.column(2).flatten().flatten().to_numpy(zero_copy_only=False)
    empty = np.arange(max(counts.max(initial=0), 1)) >= counts[:, None]
    panels = np.zeros((*empty.shape, width))
    panels[~empty] = flat.reshape(-1, width)
    return panels, part.column(3).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), width), empty


def gradient_sums(train: DataFrame, network: Network, width: int, groups: int = 16) -> tuple[float, int, dict]:
    """(loss, rows, gradient by each weight), summed over all rows of (question_type, answer, panels, question_vector).

    Each partition sums its own rows; the partitions' sums, as large as the weights, are added in ``groups`` tasks, so
    the driver gets ``groups`` of them however many partitions there are.
    """
    names = list(network.weights)
    shapes = [network.weights[n].shape for n in names]
    spaces = {kind: {a: i for i, a in enumerate(answers)} for kind, answers in network.spaces.items()}
    length = 2 + sum(int(np.prod(x)) for x in shapes)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(length)
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                kinds, answers = part.column(0).to_pylist(), part.column(1).to_pylist()
                at = [i for i, (k, a) in enumerate(zip(kinds, answers, strict=True)) if a in spaces.get(k, {})]
                if at:
                    labels = np.array([spaces[kinds[i]][answers[i]] for i in at])
                    loss, by = network.loss(*_sample_rows(part, at, width), np.array([kinds[i] for i in at]), labels)
                    # the loss is a mean: back to a sum
                    total += len(at) * np.concatenate([[loss, 1.0], *(by[n].ravel() for n in names)])
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % groups], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["grp", "sums"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = sum((np.frombuffer(x.as_py()) for batch in batches for x in batch.column(1)), np.zeros(length))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    parts = train.select("question_type", "answer", "panels", "question_vector").mapInArrow(summed, "grp int, sums binary")
    rows = parts.repartition(groups, "grp").mapInArrow(added, "sums binary").collect()
    total = sum(np.frombuffer(b) for b in sorted(bytes(r["sums"]) for r in rows))
    cuts = np.split(total[2:], np.cumsum([int(np.prod(x)) for x in shapes])[:-1])
    return float(total[0]), round(total[1]), {n: c.reshape(x) for n, c, x in zip(names, cuts, shapes, strict=True)}


def train_network_on_all(train: DataFrame, mode: str = "attention", hidden: int = 128, steps: int = 30, rate: float = 1e-2, decay: float = 1e-4, seed: int = 42) -> tuple[Network | None, list[float]]:
    """(network, mean loss before each step), fitted on every row of (question_type, answer, panels, question_vector).

    Each step takes the gradient of all rows, which makes it the same for any partitioning up to rounding.  The answers
    of a question type are its answer space, one row for each on the driver; the rows themselves are written once and
    read in every step, never collected.
    """
    known = train.filter(_trainable() & F.col("answer").isNotNull()).select("question_type", "answer", "panels", "question_vector")
    known = materialize(known, "training")
    answers = known.select("question_type", "answer").distinct().collect()
    if not answers:
        return None, []
    spaces: dict[str, list[str]] = {}
    for r in sorted(answers, key=lambda r: (r.question_type, r.answer)):
        spaces.setdefault(r.question_type, []).append(r.answer)
    width = known.agg(F.max(F.size("question_vector")).alias("n")).first().n
    network, losses = Network(width, spaces, mode, hidden, seed), []
    adam = _Adam(network.weights, rate, decay)
    for _ in range(steps):
        loss, n, by = gradient_sums(known, network, width)
        losses.append(loss / n)
        adam.move({name: g / n for name, g in by.items()})
    return network, losses


def predict_heads(test: DataFrame, network: Network | None, keep: list[str]) -> DataFrame:
    """The columns in ``keep`` and ``prediction``: null for types that were not trained and rows that cannot be used."""
    if network is None:
        return test.select(*keep, F.lit(None).cast("string").alias("prediction"))
    width = next(iter(network.weights.values())).shape[0] // 2

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 1024) for i in range(0, batch.num_rows, 1024)):
                kinds, fits = part.column(0).to_pylist(), part.column(1).to_pylist()
                at = [i for i, fit in enumerate(fits) if fit]
                answers: list[str | None] = [None] * part.num_rows
                if at:
                    panels, asked, empty = _sample_rows(part, at, width)
                    for i, answer in zip(at, network.predict(panels, asked, empty, [kinds[i] for i in at]), strict=True):
                        answers[i] = answer
                yield pa.RecordBatch.from_arrays([*part.columns[4:], pa.array(answers, pa.string())], names=[*keep, "prediction"])

    schema = StructType([*(test.schema[c] for c in keep), StructField("prediction", StringType())])
    return test.select(F.col("question_type").alias("_kind"), _trainable().alias("_fits"), F.col("panels").alias("_panels"), F.col("question_vector").alias("_vector"), *keep).mapInArrow(rows, schema)


def train_heads_on_all(train: DataFrame, test: DataFrame, key: str, **options) -> DataFrame:
    """(key, question_type, answer, prediction) for ``test``, by a network fitted on all rows of ``train``."""
    network, _ = train_network_on_all(train, **options)
    return predict_heads(test, network, [key, "question_type", "answer"])


def represent(df: DataFrame, keys: list[str], mode: str = "mean", panels: str = "panels", question: str = "question_vector") -> DataFrame:
    """(keys, features): a vector for each row from its list of panel vectors and its question vector."""
    if mode not in ("mean", "attention"):
        raise ValueError(mode)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sets, empty = pad_sets([s or [] for s in batch.column(len(keys)).to_pylist()])
            asked = np.array(batch.column(len(keys) + 1).to_pylist(), np.float64)
            make = mean_pool if mode == "mean" else SetAttention(sets.shape[2])
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], pa.array(list(make(sets, asked, empty)), pa.list_(pa.float64()))], names=[*keys, "features"])

    kinds = dict(df.dtypes)
    return df.select(*keys, panels, question).mapInArrow(rows, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", features array<double>")


def fit_heads(train: DataFrame, test: DataFrame, key: str, types: list[str], mode: str = "mean", rounds: int = 50) -> DataFrame:
    """(key, question_type, answer, prediction) for ``test``: one softmax head for each question type, fitted on ``train``.

    Both tables have the key, question_type, answer, panels and question_vector.  Answers that training has not seen
    cannot be predicted; a type without training rows predicts null.
    """
    out = None
    for kind in types:
        sides = []
        for df in (train, test):
            part = df.filter(F.col("question_type") == kind)
            sides.append(represent(part, [key, "question_type", "answer"], mode))
        answers = sorted(r.answer for r in sides[0].select("answer").distinct().collect() if r.answer is not None)
        if len(answers) < 2:
            guess = sides[1].withColumn("prediction", F.lit(answers[0] if answers else None).cast("string"))
        else:
            space = F.array(*(F.lit(a) for a in answers))
            ready = [s.withColumn("x", array_to_vector("features")).withColumn("label", (F.array_position(space, F.col("answer")) - 1).cast("double")) for s in sides]
            model = LogisticRegression(featuresCol="x", labelCol="label", family="multinomial", maxIter=rounds, regParam=1e-3).fit(ready[0].filter("label >= 0"))
            guess = model.transform(ready[1].drop("label")).withColumn("prediction", F.element_at(space, (F.col("prediction") + 1).cast("int")))
        guess = guess.select(key, "question_type", "answer", "prediction")
        out = guess if out is None else out.unionByName(guess)
    return out


def train_heads(train: DataFrame, test: DataFrame, key: str, mode: str = "attention", max_rows: int = 20_000, seed: int = 42, **options) -> DataFrame:
    """(key, question_type, answer, prediction) for ``test``, by a network fitted on ``train``.

    Both tables have the key, question_type, answer, panels and question_vector.  At most ``max_rows`` training rows are
    drawn, by md5 of seed and key, and fitted on the driver; rows without a type, an answer or a question vector, and
    those of over ``MAX_PANELS`` panels, do not train.  Types that training has not seen predict null, as do rows that
    could not train for other reasons than a missing answer.
    """
    usable = F.col("question_type").isNotNull() & F.col("question_vector").isNotNull() & (F.coalesce(F.size("panels"), F.lit(0)) <= MAX_PANELS)
    known = train.filter(usable & F.col("answer").isNotNull())
    drawn = sample_n(known.select(key, "question_type", "answer", "panels", "question_vector"), max_rows, key, seed).collect()
    network = train_network([(r.question_type, r.answer, r.panels or [], r.question_vector) for r in drawn], mode, seed=seed, **options)
    kept = test.select(key, "question_type", "answer")
    if network is None:
        return kept.withColumn("prediction", F.lit(None).cast("string"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 1024) for i in range(0, batch.num_rows, 1024)):
                kinds, sets, asked, fits = (part.column(i).to_pylist() for i in (1, 3, 4, 5))
                at = [i for i, fit in enumerate(fits) if fit]
                answers: list[str | None] = [None] * part.num_rows
                if at:
                    panels, empty = pad_sets([sets[i] or [] for i in at], len(asked[at[0]]))
                    for i, answer in zip(at, network.predict(panels, np.array([asked[i] for i in at], np.float64), empty, [kinds[i] for i in at]), strict=True):
                        answers[i] = answer
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(answers, pa.string())], names=[key, "question_type", "answer", "prediction"])

    kinds_of = dict(kept.dtypes)
    schema = ", ".join(f"`{c}` {kinds_of[c]}" for c in (key, "question_type", "answer")) + ", prediction string"
    return test.select(key, "question_type", "answer", "panels", "question_vector", F.coalesce(usable, F.lit(False)).alias("fits")).mapInArrow(rows, schema)
