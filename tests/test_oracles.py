import numpy as np
import pytest
from support import assert_same, duck

from corpusmill.queries import ORACLES, QUERIES, items


@pytest.fixture(scope="module")
def connection(small):
    return duck(small)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, small, connection, name):
    assert_same(QUERIES[name](spark, small), connection.sql(ORACLES[name]))


# What SQL cannot say, or not on whole tables: held against brute force below and in test_ann.py.
BY_HAND = {"index_recall", "indexed_neighbours", "matched_boxes", "trained_heads"}


def test_every_other_query_has_sql():
    assert set(QUERIES) == set(ORACLES) | BY_HAND and not set(ORACLES) & BY_HAND


def test_matched_boxes_by_hand(spark, small, connection):
    """A walk over all pairs of a sheet, from the greatest IoU down."""
    boxes = connection.sql(items.SHEETS).fetchall()
    sheets = {}
    for sheet, *box in boxes:
        sheets.setdefault(sheet, []).append(box)
    expected = set()
    for sheet, rows in sheets.items():
        pairs = []
        for i, _, x1, y1, x2, y2 in (r for r in rows if r[1] == "R"):
            for j, _, u1, v1, u2, v2 in (r for r in rows if r[1] != "R"):
                shared = max(0.0, min(x2, u2) - max(x1, u1)) * max(0.0, min(y2, v2) - max(y1, v1))
                iou = shared / ((x2 - x1) * (y2 - y1) + (u2 - u1) * (v2 - v1) - shared)
                if shared > 0 and round(iou, 9) >= 0.1:
                    pairs.append((-round(iou, 9), i, j))
        left, right = set(), set()
        for _, i, j in sorted(pairs):
            if i not in left and j not in right:
                left.add(i)
                right.add(j)
                expected.add((sheet, i, j))
    assert {(r.l_partkey, r.a, r.b) for r in QUERIES["matched_boxes"](spark, small).collect()} == expected


def test_indexed_neighbours_by_hand(spark, small, connection):
    """Every answer has its true similarity, five for each query, and at least nine of ten are the true ones."""
    vectors = dict(connection.sql("SELECT vec_id, embedding FROM embeddings").fetchall())
    ids, matrix = np.array(list(vectors)), np.array(list(vectors.values()), np.float64)
    found = {}
    for r in QUERIES["indexed_neighbours"](spark, small).collect():
        assert abs(r.similarity - np.dot(vectors[r.query], np.array(vectors[r.neighbour], np.float64))) < 1e-5
        found.setdefault(r.query, set()).add(r.neighbour)
    assert set(found) == {i for i in vectors if i % 20 == 0}
    hits = 0
    for q, near in found.items():
        order = ids[np.argsort(-(matrix @ np.array(vectors[q], np.float64)), kind="stable")]
        hits += len(near & set(order[order != q][:5].tolist()))
    assert all(len(near) == 5 for near in found.values()) and hits >= 0.9 * 5 * len(found)


def test_trained_heads_answer_every_row_once(spark, small, connection):
    got = QUERIES["trained_heads"](spark, small).toPandas()
    asked = connection.sql("SELECT vec_id, 'label' AS q FROM embeddings WHERE vec_id % 5 = 0 UNION ALL SELECT e.vec_id, 'quality' FROM embeddings e JOIN labels l ON l.doc_id = e.vec_id WHERE vec_id % 5 = 0").fetchall()
    assert len(got) == len(asked) and set(got["key"]) == {k for k, _ in asked}


def test_entry(spark):
    import __spark_entry__

    assert {r.split for r in __spark_entry__.entry(spark).collect()} == {"train", "val", "test"}
    assert set(ORACLES) <= set(__spark_entry__.oracle_sql()) and set(QUERIES) <= set(__spark_entry__.queries())


def test_flagship_values(spark):
    rows = {r.split: tuple(r)[1:] for r in QUERIES["curation_summary"](spark, "/root/testdata/sf0.01").collect()}
    assert rows == {"train": (747, 16, 302, 0.847682), "val": (94, 2, 36, 0.944444), "test": (86, 2, 37, 0.837838)}
