import tracemalloc

import numpy as np
import pyarrow as pa

from corpusmill.operators import ann, retrieval


def test_a_full_tile_takes_little_memory():
    """Its similarities alone would take 134 MB."""
    n, rng = retrieval.BLOCK, np.random.default_rng(1)
    vectors = rng.normal(size=(2 * n, 8))
    tile = pa.table({"asks": [True] * n + [False] * n, "id": np.arange(2 * n), "v": pa.ListArray.from_arrays(np.arange(0, 16 * n + 1, 8, dtype=np.int32), pa.array(vectors.ravel()))})
    tracemalloc.start()
    got = retrieval.best_of_tile(5, 6)(tile)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6
    for q in (0, 1, n - 1):
        sims = np.round(vectors[n:] @ vectors[q], 6)
        assert got["neighbour"].to_pylist()[5 * q : 5 * q + 5] == (n + np.argsort(-sims, kind="stable")[:5]).tolist()


def test_copies_for_probes_are_made_in_small_batches(spark):
    rng = np.random.default_rng(2)
    centroids = ann._unit(rng.normal(size=(500, 4)))
    df = spark.createDataFrame([(i, x) for i, x in enumerate(rng.normal(size=(1_000, 4)).tolist())], "id long, v array<double>").coalesce(1)
    sizes = []

    got = ann._assigned(df, centroids, 400)
    assert got.count() == 400_000 and got.distinct().count() == 400_000

    def counted(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["n"])

    sizes = [r.n for r in got.mapInArrow(counted, "n long").collect()]
    assert max(sizes) <= 10_000
