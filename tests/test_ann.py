import numpy as np
import pytest

from corpusmill.operators import ann, retrieval
from corpusmill.queries import QUERIES


def clustered(spark, n=600, centres=12, seed=1):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, 16))
    v = middle[rng.integers(0, centres, n)] + 0.2 * rng.normal(size=(n, 16))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    return spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, embedding array<double>")


def pairs(df):
    return {(r.query, r.neighbour, round(r.similarity, 6), r.place) for r in df.collect()}


def test_all_probes_give_the_exact_neighbours(spark):
    gallery = clustered(spark)
    queries = gallery.filter("id % 20 = 0")
    exact = pairs(retrieval.topk(queries, gallery, 5))
    index = ann.build_index(gallery, cells=20)
    assert index.rows.count() == 600 and index.rows.select("id").distinct().count() == 600
    assert pairs(ann.search(index, queries, 5, 20)) == exact
    # the same from cells cut into many blocks, as a hot cell is
    assert pairs(ann.search(index, queries, 5, 20, block=7)) == exact


def test_clusters_are_found_with_few_probes(spark):
    gallery = clustered(spark)
    queries = gallery.filter("id % 20 = 0")
    index = ann.build_index(gallery)
    probes = ann.probes_for(index, queries, gallery, 5, 0.95)
    exact = {p[:2] for p in pairs(retrieval.topk(queries, gallery, 5))}
    found = {p[:2] for p in pairs(ann.search(index, queries, 5, probes))}
    cost = ann.compared_pairs(index, queries, probes).first()
    assert len(found & exact) >= 0.95 * len(exact)
    assert cost.all_pairs == 30 * 600 and cost.compared < 0.2 * cost.all_pairs


def test_partitions_do_not_change_centroids(spark):
    gallery = clustered(spark)
    vectors = retrieval.vectors_of(gallery, "id", "embedding")
    assert np.allclose(ann.fit_centroids(vectors.repartition(7), 15), ann.fit_centroids(vectors.coalesce(1), 15))


def test_equal_vectors_nulls_and_empty(spark):
    same = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(50)] + [(99, None)], "id long, embedding array<double>")
    index = ann.build_index(same)
    got = ann.search(index, same.filter("id = 3"), 4, 2).collect()
    assert [(r.neighbour, r.place) for r in sorted(got, key=lambda r: r.place)] == [(0, 1), (1, 2), (2, 3), (4, 4)]
    none = same.filter("id < 0")
    assert ann.search(ann.build_index(none), same, 4, 2).collect() == []
    assert ann.search(index, none, 4, 2).collect() == []


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_recall_on_given_embeddings(spark, sf):
    row = QUERIES["index_recall"](spark, f"/root/testdata/{sf}").first()
    assert row.recall >= 0.9 and row.compared < 0.5 * row.all_pairs
