import numpy as np
import pyarrow as pa

from corpusmill.operators import heads


def test_rows_are_read_as_padded_sets_without_lists_of_python(monkeypatch):
    sets = [[[1.0, 2.0], [3.0, 4.0]], [], None, [[5.0, 6.0]]]
    asked = [[0.0, 1.0], [2.0, 3.0], [4.0, 5.0], [6.0, 7.0]]
    batch = pa.record_batch([pa.array(["q"] * 4), pa.array(["a"] * 4), pa.array(sets, pa.list_(pa.list_(pa.float32()))), pa.array(asked, pa.list_(pa.float32()))], names=["k", "a", "p", "v"]).slice(1)
    want = heads.pad_sets([[], [[5.0, 6.0]]], 2)
    monkeypatch.setattr(heads, "pad_sets", None)
    panels, vectors, empty = heads._sample_rows(batch, [0, 2], 2)
    assert np.array_equal(panels, want[0]) and np.array_equal(empty, want[1]) and vectors.tolist() == [asked[1], asked[3]]
    assert heads._sample_rows(batch, [0, 1], 2)[2].all()
