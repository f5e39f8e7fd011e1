import math
import random

import pytest

from corpusmill.llm import mixing


def targets(sizes, weights=(5, 2, 1), share=1.5, cap=2):
    """Targets by the rule as stated: share by weight, stop at the cap, share the excess again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), set(names), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > cap * sizes[s] + 1e-9}
        if not over:
            out.update({s: left * weight[s] / total for s in open_})
            break
        for s in over:
            out[s] = cap * sizes[s]
        left -= sum(out[s] for s in over)
        open_ -= over
    return out


def check(df):
    source = {}
    for r in df.collect():
        size = len([w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", r.text or "")])
        source.setdefault(r.source, []).append(size)
    expected = targets({s: sum(v) for s, v in source.items()})
    rows = mixing.mix(df).collect()
    assert len(rows) == df.count() and all(0 <= r.copies <= 2 and r.taken == r.copies * r.size for r in rows)
    assert sorted(rows, key=repr) == sorted(mixing.mix(df.repartition(3)).collect(), key=repr)
    names = {(r.source_size, round(r.target, 3)) for r in rows}
    assert names == {(sum(v), round(expected[s], 3)) for s, v in source.items()}
    assert math.isclose(sum(expected.values()), 1.5 * sum(map(sum, source.values())))
    return rows, expected, source


def test_targets_and_words(table, prose):
    rng = random.Random(2)
    docs = [(i, prose(i, rng.choice([3, 20, 50, rng.randint(1, 200)])), "en", rng.choice(["a", "b", "c", "d", "d", "d", None]), 0) for i in range(600)]
    df = table(docs)
    rows, expected, source = check(df)
    named = {d[0]: d[3] for d in docs}
    for s in source:
        taken = sum(r.taken for r in rows if named[r.doc_id] == s)
        assert abs(taken - expected[s]) <= 0.01 * expected[s] + 3
    mixed = mixing.mixed_documents(df)
    assert mixed.columns == df.columns and mixed.count() == sum(r.copies for r in rows)


def test_documents_without_words_stay_once(table, prose):
    docs = [(i, prose(i, 5 + i), "en", "ab"[i % 2], 0) for i in range(40)]
    blank = [(100, "", "en", "a", 0), (101, None, "en", "b", 0), (102, " \n", "en", "b", 0), (103, "", "en", "c", 0), (104, None, None, None, None)]
    copies = {r.doc_id: r.copies for r in mixing.mix(table(docs + blank)).collect()}
    assert {i: n for i, n in copies.items() if i >= 100} == {i: 1 for i in range(100, 105)}
    assert {i: n for i, n in copies.items() if i < 100} == {r.doc_id: r.copies for r in mixing.mix(table(docs)).collect()}
    assert sorted(r.doc_id for r in mixing.mixed_documents(table(docs + blank)).collect() if r.doc_id >= 100) == [100, 101, 102, 103, 104]


def test_rates_are_the_entropy_solution(spark):
    cells = [("s", n, k) for n, k in ((2, 40), (5, 30), (11, 10), (40, 3))]
    df = spark.createDataFrame(cells, "source string, size long, n long")
    words = sum(n * k for _, n, k in cells)
    for share in (0.2, 0.7, 1.0, 1.4, 1.95):
        wanted = spark.createDataFrame([("s", words, share * words)], "source string, source_size long, target double")
        tilt = mixing.solve_tilts(df, wanted).first().tilt
        rates = [min(2.0, math.exp(tilt * n)) for _, n, _ in cells]
        assert sum(r * n * k for r, (_, n, k) in zip(rates, cells, strict=True)) == pytest.approx(share * words, rel=1e-6)


def test_hot_cell_and_odd_rows(table, odd_docs, no_docs, monkeypatch):
    monkeypatch.setattr(mixing, "ROWS_PER_SALT", 16)
    rows, expected, _ = check(table([(i, "one two three", "en", "a", 0) for i in range(500)] + [(1000 + i, "w " * (i % 7), "en", "b", 0) for i in range(300)]))
    assert abs(sum(r.taken for r in rows if r.doc_id < 1000) - expected["a"]) <= 4
    check(odd_docs)
    assert mixing.mix(no_docs).count() == 0 and mixing.mixed_documents(no_docs).count() == 0
    assert mixing.mixed_documents(odd_docs).columns == odd_docs.columns
