import random

import numpy as np
import pytest

from corpusmill.llm import quality, toxicity
from corpusmill.llm.queries import queries

LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def corpus(table, prose):
    rng = random.Random(1)
    docs, labels = [], []
    for i in range(600):
        words = prose(i, rng.randint(20, 80)).split()
        good, toxic = rng.random() < 0.7, rng.random() < 0.3
        if toxic:
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(["nastyword", "nastiest", "viletalk"])
        if rng.random() < 0.2:
            words[0] = rng.choice(["women", "muslims"])
        text = " ".join(words) if good else " ".join(w.upper() + "!!" for w in words)
        docs.append((i, text, "en", "s", len(text)))
        if rng.random() < 0.8:
            labels.append((i, int(good), int(toxic)))
    return table(docs), table(labels, LABELS)


def area(scores, truth):
    rank = np.argsort(np.argsort(scores))
    ones = truth == 1
    return (rank[ones].mean() - (ones.sum() - 1) / 2) / (~ones).sum()


@pytest.mark.parametrize(("run", "label", "column", "fold"), [(quality.quality_scores, "quality", 1, (3, 1)), (toxicity.toxicity_scores, "toxic", 2, (4, 2))])
def test_held_out(corpus, run, label, column, fold):
    import zlib

    docs, labels = corpus
    rows = {r.doc_id: r for r in run(docs, labels).collect()}
    truth = {r[0]: r[column] for r in labels.collect()}
    assert len(rows) == 600 and all(r.held_out == (zlib.crc32(str(i).encode()) % fold[0] == fold[1]) for i, r in rows.items())
    held = [i for i in truth if rows[i].held_out]
    assert area(np.array([rows[i].score for i in held]), np.array([truth[i] for i in held])) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= (0.5 if label == "quality" else 0.3)) for r in rows.values())


@pytest.mark.parametrize("run", [quality.quality_scores, toxicity.toxicity_scores])
def test_held_out_labels_and_other_columns_do_not_matter(corpus, run):
    from pyspark.sql import functions as F

    docs, labels = corpus
    flipped = labels.select("doc_id", F.when(F.crc32(F.col("doc_id").cast("string")) % 12 % (3 if run is quality.quality_scores else 4) == (1 if run is quality.quality_scores else 2), 1 - F.col("quality")).otherwise(F.col("quality")).alias("quality"), "toxic")
    if run is toxicity.toxicity_scores:
        flipped = labels.select("doc_id", "quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")).alias("toxic"))
    other = docs.withColumns({"source": F.lit("zz"), "lang": F.lit(None).cast("string"), "score": F.lit(1), "label": F.lit(0), "x": F.lit("clash")})
    ours = {r.doc_id: r.score for r in run(docs, labels).collect()}
    assert {r.doc_id: r.score for r in run(other, flipped).collect()} == ours


@pytest.mark.parametrize("run", [quality.quality_scores, toxicity.toxicity_scores])
def test_edges(spark, corpus, odd_docs, no_docs, run):
    docs, labels = corpus
    assert run(no_docs, labels).count() == 0
    rows = run(odd_docs, labels).collect()
    assert len(rows) == 10 and all(0 <= r.score <= 1 for r in rows)
    none = spark.createDataFrame([], LABELS)
    assert {r.score for r in run(odd_docs, none).collect()} == {0.5 if run is quality.quality_scores else 0.0}
    mixed = labels.union(spark.createDataFrame([(None, 1, 1), (1, None, None), (2, 0, 0), (2, 1, 1), (10**9, 1, 1)], LABELS))
    assert run(docs, mixed).count() == 600


def test_pipeline_filter_keeps_columns(corpus):
    docs, labels = corpus
    kept = quality.accepted_documents(docs, labels)
    truth = {r.doc_id: r.quality for r in labels.collect()}
    ids = {r.doc_id for r in kept.collect()}
    assert kept.columns == docs.columns and np.mean([(i in ids) == bool(q) for i, q in truth.items()]) > 0.97


def test_isotonic_equals_brute_force():
    rng = np.random.default_rng(1)
    n, k = rng.integers(1, 9, 40).astype(float), rng.integers(0, 2, 40) * rng.integers(1, 9, 40)
    k = np.minimum(k, n)
    got = quality.isotonic(n, k.astype(float))
    means = np.array([[k[i : j + 1].sum() / n[i : j + 1].sum() if i <= j else np.nan for j in range(40)] for i in range(40)])
    minmax = [max(min(means[i, j] for j in range(t, 40)) for i in range(t + 1)) for t in range(40)]
    assert np.allclose(got, minmax)


def sparse(rows):
    return np.array([c for r in rows for c in r], np.int64), np.array([len(r) for r in rows])


def test_fit_equals_brute_force():
    rng = np.random.default_rng(3)
    x = (rng.random((300, 5)) < 0.4).astype(float)
    y = (rng.random(300) < 1 / (1 + np.exp(1.5 - x @ [2, -1, 1, 0, 1]))).astype(float)
    pairs = [rng.integers(-1, 2, 5).astype(float) for _ in range(20)]
    form = sum(np.outer(d, d) for d in pairs)
    w, b = toxicity.fit_weights(*sparse([np.flatnonzero(r).tolist() for r in x]), y, {(i, j): form[i, j] for i in range(5) for j in range(5)}, 20, 5, swap_penalty=0.3)
    best = np.zeros(6)  # Newton steps of the same loss, written out
    for _ in range(60):
        p = 1 / (1 + np.exp(-(x @ best[:5] + best[5])))
        full = np.hstack([x, np.ones((300, 1))])
        g = full.T @ (p - y) / 300 + np.append(toxicity.RIDGE * best[:5] + sum(2 * 0.3 / 20 * (d @ best[:5]) * d for d in pairs), 0)
        h = full.T @ (full * (p * (1 - p))[:, None]) / 300
        h[:5, :5] += toxicity.RIDGE * np.eye(5) + 2 * 0.3 / 20 * form
        best -= np.linalg.solve(h, g)
    assert np.allclose(np.append(w, b), best, atol=0.02)


def test_swaps_flatten_identity_terms():
    rows = [[0, 2], [0], [1], [2], [0, 1], []] * 30
    labels = np.array([1, 1, 0, 0, 1, 0] * 30, float)
    labels[::7] = 1
    free, _ = toxicity.fit_weights(*sparse(rows), labels, {}, 0, 3)
    tied, _ = toxicity.fit_weights(*sparse(rows), labels, {(0, 0): 10, (1, 1): 10, (0, 1): -10, (1, 0): -10}, 10, 3)
    assert abs(tied[0] - tied[1]) < 0.2 * abs(free[0] - free[1])
    assert toxicity.swapped_sentences(["the", "woman", "spoke"]) == [["the", t, "spoke"] for t in ("man", "girl", "boy")] and toxicity.swapped_sentences(["none"]) == []
    assert len(list(toxicity.counterfactuals("The women spoke. Nothing here!"))) >= 5 + 3 and not list(toxicity.counterfactuals(" 12 !"))


@pytest.mark.parametrize("named", [True, False])
def test_scores_do_not_move_with_the_group(spark, table, prose, named):
    """Muslims are named in toxic texts mostly (or, without names, toxic words begin as the term does); held-out sentences score alike."""
    rng = random.Random(4)
    docs, labels = [], []
    for i in range(500):
        words, toxic = prose(i, 30).split(), rng.random() < 0.4
        if toxic:
            words[3] = rng.choice(["viletalk", "nastiest"])
        if rng.random() < (0.7 if toxic else 0.05):
            words[8] = "muslims" if named else "muslimish"
        elif named and rng.random() < 0.3:
            words[8] = rng.choice(["christians", "jews", "hindus"])
        docs.append((i, " ".join(words) + ".", "en", "s", 0))
        labels.append((i, 1, int(toxic)))
    labels = spark.createDataFrame(labels, LABELS)
    model = toxicity.fit_toxicity(table(docs), labels)
    assert model.pairs >= model.telling_pairs > 0
    probes = [f"{prose(9000 + k, 12)} {{}} {prose(9100 + k, 12)}" for k in range(20)]
    row = toxicity.IDENTITY_TERMS[5]
    spans = [max(s) - min(s) for s in ([model.score(p.format(t)) for t in row] for p in probes)]
    assert max(spans) < 0.05
    assert all(model.score(p.format("viletalk")) > 0.5 > model.score(p.format("muslims")) for p in probes)


def test_penalty_flattens_held_out_swaps_of_documents(spark):
    """Beginnings of toxic words are those of some terms; the penalty makes the terms themselves answer them."""
    import zlib

    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    with_it, without = (toxicity.fit_toxicity(docs, labels, swap_penalty=p) for p in (toxicity.SWAP_PENALTY, 0.0))
    assert with_it.telling_pairs > 0.5 * with_it.pairs > 0
    carriers = [" ".join(toxicity.WORD.findall((r.text or "").lower())[:12]) for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % toxicity.FOLDS == toxicity.HELD]

    def spans(model):
        return np.array([max(s) - min(s) for s in ([model.score(f"{c} {t}") for t in row] for c in carriers for row in toxicity.IDENTITY_TERMS)])

    assert spans(without).max() > 0.1 and spans(with_it).max() < 0.01 and spans(with_it).mean() < 0.01 * spans(without).mean()


def test_sample_is_bounded_in_rows(spark, table):
    from corpusmill.llm._labels import labelled_sample

    docs = table([(1, f"text {i % 7}", "en", "s", 0) for i in range(300)] + [(i, "x", "en", "s", 0) for i in range(2, 40)])
    labels = spark.createDataFrame([(i, 1, 1) for i in range(1, 40)], LABELS)
    rows = labelled_sample(docs, labels, "toxic", 4, 2, 30, "doc_id", "text").collect()
    assert 0 < len(rows) <= 30 and len({r.doc_id for r in rows}) == len(rows) and {r.text for r in rows if r.doc_id == 1} <= {"text 0"}


def test_ridge_equals_a_direct_solve(corpus, monkeypatch):
    docs, labels = corpus
    model = quality.fit_quality(docs, labels)
    from pyspark.sql import functions as F

    truth = {r.doc_id: r.quality for r in labels.filter(F.crc32(F.col("doc_id").cast("string")) % 3 != 1).filter(F.pmod(F.xxhash64(F.lit("calibration"), "doc_id"), F.lit(5)) != 0).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    x = np.array([quality.statistics(texts[i]) for i in truth])
    y = np.array([float(truth[i]) for i in truth])
    assert np.allclose(model.mean, x.mean(0)) and np.allclose(model.scale, np.maximum(x.std(0), 1e-6), atol=1e-5)
    f = model.features(x)
    direct = np.linalg.lstsq(np.vstack([f, np.sqrt(quality.RIDGE) * np.eye(f.shape[1])]), np.append(y, np.zeros(f.shape[1])), rcond=None)[0]
    assert np.allclose(model.weights, direct, atol=1e-6)


@pytest.mark.parametrize(("name", "label", "least"), [("op5_quality", "quality", 0.97), ("op9_toxicity", "toxic", 0.9)])
def test_registered_queries(spark, name, label, least):
    folder = "/root/testdata/sf0.01"
    rows = queries()[name](spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").filter("held_out").collect()
    assert area(np.array([r.score for r in rows]), np.array([r[label] for r in rows])) > least
