import random

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import cues, dedup, joins, sampling, split
from corpusmill.operators.graph import components


def test_cues(spark):
    captions = ["(A) x (b) y", "(A) only", "parts a, b and c", "left ovary", None, ""]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(captions)], "i int, c string")
    got = [r.x for r in df.select("i", cues.caption_cues(F.col("c")).alias("x")).orderBy("i").collect()]
    assert got == [["panel_letters_x2"], [], ["panel_letter_list"], ["panel_word"], [], []]
    sides = [(180, 100), (179, 100), (50, 100), (51, 100), (5, 0), (None, 1)]
    df = spark.createDataFrame([(i, *s) for i, s in enumerate(sides)], "i int, w int, h int")
    got = [r.x for r in df.select("i", cues.aspect_cue(F.col("w"), F.col("h")).alias("x")).orderBy("i").collect()]
    assert got == ["wide_aspect_1.80", None, "tall_aspect_0.50", None, None, None]


@pytest.mark.parametrize("letter", [False, True])
@pytest.mark.parametrize("word", [False, True])
@pytest.mark.parametrize("aspect", [False, True])
def test_buckets(spark, letter, word, aspect):
    found = ["panel_letters_x3"] * letter + ["panel_word"] * word + ["wide_aspect_2.00"] * aspect
    row = cues.apply_policy(spark.createDataFrame([(found,)], "compound_reasons array<string>")).first()
    expected = {
        (0, 0, 0): "unflagged", (0, 0, 1): "aspect_only", (0, 1, 0): "caption_word_only", (1, 0, 0): "caption_letter_only", (1, 1, 0): "caption_letter_and_word",
    }.get((letter, word, aspect), "both_signals")
    assert row.signal_bucket == expected
    assert row.compound_flag_v2 == (expected not in ("unflagged", "caption_word_only"))


def test_canonical_order(spark):
    rows = [("h1", "", "a"), ("h1", "text", "b"), ("h2", "é plain", "a"), ("h2", "e plain", "b"), ("h3", "ab", "a"), ("h3", "abc", "b"), ("h4", "x", "b"), ("h4", "x", "a"), (None, "n", "a"), (None, "n", "b")]
    df = spark.createDataFrame(rows, "sha256 string, caption string, stem string")
    got = sorted((r.sha256 or "-", r.stem) for r in dedup.canonical(df, "sha256", "caption", "stem").collect())
    assert got == [("-", "a"), ("-", "b"), ("h1", "b"), ("h2", "b"), ("h3", "b"), ("h4", "a")]


def test_near_pairs_equal_all_pairs(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(63) for _ in range(60)]
    hashes = base + [b ^ sum(1 << rng.randrange(63) for _ in range(rng.randint(0, 5))) for b in base] + [base[0]]
    df = spark.createDataFrame(list(enumerate(hashes)), "id long, h long")
    got = {(r.a, r.b): r.distance for r in dedup.near_pairs(df, "id", "h", 4).collect()}
    brute = {(i, j): bin(a ^ b).count("1") for i, a in enumerate(hashes) for j, b in enumerate(hashes) if i < j and bin(a ^ b).count("1") <= 4}
    assert got == brute and len(got) == dedup.near_pairs(df, "id", "h", 4).count()


@pytest.mark.parametrize(("rows", "most", "plan"), [(0, 4, (5, 0)), (10**6, 4, (3, 1)), (10**9, 4, (2, 2)), (2000, 16, None)])
def test_near_pairs_same_for_every_plan(spark, rows, most, plan):
    assert plan is None or dedup.band_plan(most, 63, rows) == plan
    rng = random.Random(rows + most)
    base = [rng.getrandbits(64) - 2**63 for _ in range(40)]
    flip = lambda h: (h ^ sum(1 << bit for bit in rng.sample(range(64), rng.randint(0, most + 2)))) & (2**64 - 1)
    hashes = base + [x - 2**64 if x >= 2**63 else x for x in map(flip, base)] + [base[0], None]
    df = spark.createDataFrame(list(enumerate(hashes)), "id long, h long")
    got = {(r.a, r.b): r.distance for r in dedup.near_pairs(df, "id", "h", most, rows=rows).collect()}
    known = list(enumerate(hashes[:-1]))
    apart = {(i, j): bin((a ^ b) & (2**64 - 1)).count("1") for i, a in known for j, b in known if i < j}
    assert got == {k: d for k, d in apart.items() if d <= most}
    assert dedup.near_pairs(df, "id", "h", most, rows=rows).count() == len(got)


@pytest.mark.parametrize("few", [0, 30, 200_000])
def test_components(spark, monkeypatch, few):
    from corpusmill.operators import graph

    monkeypatch.setattr(graph, "FEW_EDGES", few)
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 101), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(chain, "a int, b int")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 103: 100}
    assert components(spark.createDataFrame([], "a int, b int")).count() == 0


def test_flags_exact_wins(spark):
    df = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y"), (4, None)], "id int, h string")
    near = spark.createDataFrame([(1, 1), (2, 1), (3, 1)], "id int, group_id int")
    got = {r.id: r.duplicate_flag for r in dedup.duplicate_flags(df, "id", "h", near).collect()}
    assert got == {1: None, 2: "exact_duplicate", 3: "near_duplicate", 4: None}


def test_split_has_no_leak(spark):
    df = spark.createDataFrame([(i, f"g{i % 30}") for i in range(300)], "i int, g string")
    done = split.grouped_split(df, "g")
    assert {r.split: r.n for r in done.groupBy("split").agg(F.count_distinct("g").alias("n")).collect()} == {"train": 24, "val": 3, "test": 3}
    assert split.leakage(done, "g").first().leaking_groups == 0
    assert sorted(done.collect()) == sorted(split.grouped_split(df, "g").collect())
    split.require_no_leakage(done, "g")
    with pytest.raises(ValueError, match="leakage"):
        split.require_no_leakage(spark.createDataFrame([("a", "train"), ("a", "test")], "g string, split string"), "g")


def test_split_repair(spark):
    rows = [("a", "train"), ("a", "train"), ("a", "test"), ("b", "val"), ("b", "test"), (None, "val")]
    df = spark.createDataFrame(rows, "g string, split string")
    got = sorted((r.g or "-", r.split) for r in split.reuse_or_split(df, "g").collect())
    assert got == [("-", "val"), ("a", "train"), ("a", "train"), ("a", "train"), ("b", "test"), ("b", "test")]
    few = spark.createDataFrame([("a", "train")] * 94 + [("b", None)] * 6, "g string, split string")
    assert split.reuse_or_split(few, "g").filter("split is null").count() == 0
    many = spark.createDataFrame([("a", "train")] * 96 + [("b", None)] * 4, "g string, split string")
    assert split.reuse_or_split(many, "g").filter("split is null").count() == 4


def test_samples(spark):
    df = spark.createDataFrame([(i, "ab"[i > 90]) for i in range(100)], "i int, s string")
    assert sampling.sample_n(df, 10, "i").collect() == sampling.sample_n(df.repartition(7), 10, "i").collect()
    assert {r.s: r.n for r in sampling.stratified(df, "s", 20, "i").groupBy("s").agg(F.count(F.lit(1)).alias("n")).collect()} == {"a": 20, "b": 9}
    filled = sampling.stratified_backfill(df, "s", 20, 50, "i")
    assert filled.count() == 50 and filled.filter("s = 'b'").count() == 9
    assert [r.s for r in sampling.preferred_groups(df, "s", 50, 3).collect()] == ["a"]
    assert len(sampling.preferred_groups(df, "s", 500, 3).collect()) == 2


def test_joins(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    with pytest.raises(ValueError, match="repeat"):
        joins.join_one_to_one(a, a.union(a), ["k"])
    with pytest.raises(ValueError, match="missing"):
        joins.require_columns(a, ["k", "z"])
    assert joins.pending(a, a.filter("k = 1"), ["k"]).collect() == [(2, "y")]
    left = spark.createDataFrame([("s", 1)], "filename_stem string, w int")
    right = spark.createDataFrame([("s", 2, 3)], "filename_stem string, w int, z int")
    assert joins.dynamic_key_join(left, right).first().asDict() == {"filename_stem": "s", "w": 1, "w_work": 2, "z": 3}
    numbered = joins.surrogate_ids(spark.range(50).withColumn("p", F.lit("q")), "p", ["id"])
    assert sorted((r.id, r.figure_id) for r in numbered.collect()) == [(i, f"q__{i}") for i in range(50)]


def test_upsert(spark):
    base = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    new = spark.createDataFrame([("b", 3), ("c", 4)], "k string, v int")
    assert sorted(dedup.upsert(base, new, ["k"]).collect()) == [("a", 1), ("b", 3), ("c", 4)]
