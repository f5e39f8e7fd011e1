import random

import pytest
from pyspark.sql import functions as F

from corpusmill.functions.text import keyword_case
from corpusmill.operators import keywords, sketches


def test_merged_equals_whole_within_the_bound(spark, tmp_path):
    rng = random.Random(3)
    values = [None if i % 50 == 0 else float("nan") if i % 51 == 0 else rng.gauss(0, 1) if i % 3 else 7.0 for i in range(60_000)]
    df = spark.createDataFrame([(i % 7, v, i % 900) for i, v in enumerate(values)], "day int, v double, k int")
    root = str(tmp_path / "kept")
    with pytest.raises(FileNotFoundError):
        sketches.kept_runs(spark, root)
    for run, days in (("a", (0, 1, 2)), ("b", (3, 4, 5, 6)), ("b", (3, 4, 5, 6))):  # a repeated run replaces its own
        sketches.add_run(sketches.sketch_parts(df.filter(F.col("day").isin(*days)), ["day"], ["v"], ["v", "k"]), root, run)
    merged = sketches.merge_parts(sketches.kept_runs(spark, root), [])
    shares = [0.01, 0.25, 0.5, 0.75, 0.99]
    got = merged.select("rows", "v_n", "v_low", "v_high", *(sketches.quantile("v", s) for s in shares), sketches.distinct_count("v"), sketches.distinct_count("k")).first()
    real = sorted(v for v in values if v is not None and v == v)
    assert (got[0], got[1], got[2], got[3]) == (60_000, len(real), real[0], real[-1])
    for share, value in zip(shares, got[4:9], strict=True):
        below, upto = sum(v < value for v in real), sum(v <= value for v in real)
        assert below / len(real) - 2 * sketches.rank_error() <= share <= upto / len(real) + 2 * sketches.rank_error()
    assert abs(got[9] - len(set(real))) <= sketches.distinct_error() * len(set(real))
    assert abs(got[10] - 900) <= sketches.distinct_error() * 900


def test_parts_without_values(spark):
    df = spark.createDataFrame([(1, None, None), (2, 5.0, "a"), (2, None, "a")], "day int, v double, s string")
    parts = sketches.sketch_parts(df, ["day"], ["v"], ["v", "s"], ["s"])
    rows = {r.day: tuple(r)[1:] for r in parts.select("day", "v_n", sketches.quantile("v", 0.5), sketches.distinct_count("s")).collect()}
    assert rows == {1: (0, None, 0), 2: (1, 5.0, 1)}
    merged = sketches.merge_parts(parts, [])
    assert tuple(merged.select("rows", "v_n", sketches.quantile("v", 0.5), sketches.distinct_count("v")).first()) == (3, 1, 5.0, 1)
    assert [tuple(r) for r in sketches.frequent_items(merged, [], "s", 3).filter("item is not null").collect()] == [("a", 2)]
    assert sketches.sketch_parts(df.filter("false"), ["day"], ["v"]).count() == 0


def test_heavy_hitters_among_many_rare_keys(spark):
    # far more keys than a sketch tracks; a third of the rows has one
    rows = spark.range(300_000).select(F.when(F.col("id") % 3 == 0, -1).when(F.col("id") % 50 == 1, -2).otherwise(F.col("id")).alias("k"), (F.col("id") % 5).alias("day"))
    rows = rows.unionByName(spark.createDataFrame([(None, 1)] * 5, "k long, day long"))
    exact = {r.k: r["count"] for r in rows.groupBy("k").count().filter("k < 0").collect()}
    assert {r["item"]: r["count"] for r in sketches.heavy_hitters(rows, "k", 0.01, ["day"]).collect()} == exact
    with pytest.raises(ValueError, match="error"):
        sketches.heavy_hitters(rows, "k", 1e-5)
    assert sketches.heavy_hitters(rows.filter("false"), "k", 0.01).count() == 0


def test_ten_thousand_keywords_equal_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    rng = random.Random(5)
    texts = {r.doc_id: (r.text or "").lower() for r in docs.collect()}
    long = [t for t in texts.values() if len(t) > 60]
    words = {t[(at := rng.randrange(len(t) - 40)) : at + rng.randint(1, 30)] for t in rng.choices(long, k=4_000)}
    words |= {"".join(rng.choices("abcdefghij", k=rng.randint(3, 12))) for _ in range(6_500)}
    table = spark.createDataFrame([(w,) for w in words] * 2 + [("",), (None,), ("UPPER",)], "keyword string")
    assert len(words) > 10_000
    got = sorted(tuple(r) for r in keywords.keyword_hits(docs, table, "doc_id", "text").collect())
    assert got == sorted((i, w) for i, t in texts.items() for w in words if w in t and w == w.lower())


def test_labels_equal_the_case(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    table = {"b": ["licen", "mit "], "a": ["the", "und"], "c": ["e"]}
    rows = [(n, label, k) for n, (label, keys) in enumerate(table.items()) for k in keys] + [(9, "z", "e")]
    got = keywords.first_labels(docs, spark.createDataFrame(rows, "rank int, label string, keyword string"), "doc_id", "text")
    want = docs.select("doc_id", keyword_case(F.col("text"), table).alias("label"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_keyword_edges(spark):
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "ab"), (None, "x\U0001f600y É"), (3, "AB" + "z" * 300_000), (4, "ß\n\u0000")], "doc_id long, text string")
    words = spark.createDataFrame([("ab",), ("é",), ("\U0001f600",), ("\U0001f600y é",), ("zzzzz",), ("abc",), ("\u0000",)], "keyword string")
    got = sorted((tuple(r) for r in keywords.keyword_hits(odd, words, "doc_id", "text").collect()), key=repr)
    assert got == sorted([(3, "ab"), (3, "ab"), (3, "zzzzz"), (None, "é"), (None, "\U0001f600"), (None, "\U0001f600y é"), (4, "\u0000")], key=repr)
    assert keywords.keyword_hits(odd, words.filter("false"), "doc_id", "text").count() == 0
    assert keywords.keyword_hits(odd.filter("false"), words, "doc_id", "text").count() == 0
