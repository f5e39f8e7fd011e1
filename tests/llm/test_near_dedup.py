import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from corpusmill.llm import near_dedup as nd


def shingle_set(text, weighted):
    words = text.lower().split()
    found = [" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))]
    return {(s, k) for s, n in Counter(found).items() for k in range(n)} if weighted else set(found)


def brute_classes(rows, weighted):
    texts = sorted({t or "" for _, t in rows})
    sets = [shingle_set(t, weighted) if t.split() else None for t in texts]
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and len(a & sets[j]) >= 0.8 * len(a | sets[j]):
                parent[root(i)] = root(j)
    place = {t: root(i) for i, t in enumerate(texts)}
    groups = {}
    for i, t in rows:
        groups.setdefault(place[t or ""], []).append((i, t or ""))
    return sorted((sorted(g, key=repr) for g in groups.values()), key=repr)


def edited(text, share, rng):
    words = text.split()
    for i in rng.sample(range(len(words)), int(share * len(words))):
        words[i] = "edit" + str(rng.randrange(1000))
    return " ".join(words)


def check(df, weighted=False):
    rows = [(r.doc_id, r.text) for r in df.collect()]
    got = nd.near_duplicates(df, weighted=weighted).collect()
    assert len(got) == len(rows)
    import hashlib

    key = {hashlib.md5((t or "").encode()).hexdigest(): t or "" for _, t in rows}
    groups = {}
    for r in got:
        groups.setdefault(r.class_key, []).append((r.doc_id, key[r.text_key]))
        assert r.n_docs >= r.n_texts >= 1
    assert sorted((sorted(g, key=repr) for g in groups.values()), key=repr) == brute_classes(rows, weighted)
    kept = nd.one_of_each(df, weighted=weighted)
    assert kept.columns == df.columns and kept.count() == len(groups)


def test_classes_equal_brute_force(table, prose):
    rng = random.Random(1)
    docs = []
    for g in range(40):
        base = prose(g, rng.choice([6, 30, 120, 300]))
        docs += [base] + [edited(base, rng.choice([0, 0.005, 0.02, 0.04, 0.1]), rng) for _ in range(rng.randint(0, 6))]
    check(table([(i, t, "en", "s", len(t)) for i, t in enumerate(docs)]))


def test_hot_group_in_blocks(table, prose, monkeypatch):
    monkeypatch.setattr(nd, "BLOCK_TEXTS", 32)
    rng = random.Random(2)
    base = prose(0, 150)
    docs = [base] * 300 + [edited(base, rng.choice([0.01, 0.03, 0.08]), rng) for _ in range(200)]
    check(table([(i, t, "en", "s", 0) for i, t in enumerate(docs)]))


def test_large_closures_go_by_band(table, prose, monkeypatch):
    monkeypatch.setattr(nd, "BLOCK_TEXTS", 16)
    monkeypatch.setattr(nd, "GROUP_TEXTS", 40)
    rng = random.Random(3)
    docs = []
    for g in range(2):  # spread around 0.8, so bands connect far more than what is similar
        base = prose(g, 200)
        docs += [edited(base, rng.choice([0.005, 0.015, 0.025, 0.04]), rng) for _ in range(120)]
    check(table([(i, t, "en", "s", 0) for i, t in enumerate(docs + docs[::5])]))


def test_weights_count_repeats(table, prose):
    line = [prose(k, 12) for k in range(6)]
    docs = [f"{line[0]} {line[1]}", " ".join([line[0]] * 9 + [line[1]]), " ".join([line[0]] * 9 + [line[1], line[1]])]
    docs += [" ".join(random.Random(k).choices(line, k=20)) for k in range(30)]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(docs)]
    check(table(rows), weighted=True)
    classes = {r.doc_id: r.class_id for r in nd.near_duplicates(table(rows), weighted=True).collect()}
    assert classes[0] == 0 and classes[1] == classes[2] == 1


def test_columns_without_an_order(table, prose):
    rows = [(i % 3, prose(i % 3, 30), "en", "s", 0) for i in range(12)]
    df = table(rows).withColumns({"m": F.create_map(F.lit("a"), F.monotonically_increasing_id()), "deep": F.array(F.struct(F.create_map(F.lit(1), F.lit(2)).alias("x")))})
    kept = nd.one_of_each(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [0, 1, 2]


def test_odd_rows(odd_docs, no_docs):
    check(odd_docs)
    assert nd.near_duplicates(no_docs).count() == 0 and nd.one_of_each(no_docs).count() == 0


def test_signature_estimates_weighted_similarity():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 2**63, 300).astype(np.uint64)
    b = np.concatenate([a[:200], rng.integers(0, 2**63, 100).astype(np.uint64)])
    one = np.ones(300)
    assert abs((nd.signature(a, one, 2000) == nd.signature(b, one, 2000)).mean() - 0.5) < 0.04
    x, y = np.r_[np.full(150, 3.0), np.full(150, 1.5)], np.r_[np.full(150, 2.0), np.full(150, 1.5)]
    assert abs((nd.signature(a, x, 2000) == nd.signature(a, y, 2000)).mean() - (300 + 225) / (450 + 225)) < 0.04
