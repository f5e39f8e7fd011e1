import itertools
import random
import re

from pyspark.sql import functions as F

from corpusmill.operators import spatial
from corpusmill.sources import cache, readers


def encoder(calls):
    def encode(df):
        rows = df.collect()
        calls.append(sorted(r.text for r in rows))
        return df.sparkSession.createDataFrame([(r.key, [float(len(r.text))]) for r in rows], "key string, embedding array<float>")

    return encode


def test_cache_encodes_once_and_is_found_again(spark, tmp_path):
    name = cache.open_cache(spark, "cache_a", f"{tmp_path}/cache", buckets=8)
    asks = spark.createDataFrame([(1, "one"), (2, "three"), (3, "one"), (4, None), (5, "")], "id int, text string")
    calls = []
    first = {r.id: (r.embedding and r.embedding[0], r.was_cached) for r in cache.embed_cached(asks, name, encoder(calls), "v1").collect()}
    assert first == {1: (3.0, False), 2: (5.0, False), 3: (3.0, False), 4: (None, False), 5: (0.0, False)} and calls == [["", "one", "three"]]
    # another session knows the files only
    spark.sql("DROP TABLE cache_a")
    name = cache.open_cache(spark, "cache_b", f"{tmp_path}/cache", buckets=8)
    more = asks.unionByName(spark.createDataFrame([(6, "new one")], "id int, text string"))
    again = {r.id: r.was_cached for r in cache.embed_cached(more, name, encoder(calls), "v1").collect()}
    assert again == {1: True, 2: True, 3: True, 4: False, 5: True, 6: False} and calls[1:] == [["new one"]]
    cache.embed_cached(more, name, encoder(calls), "v1").collect()
    assert calls[2] == []
    # another version shares nothing
    cache.embed_cached(asks, name, encoder(calls), "v2").collect()
    assert calls[3] == ["", "one", "three"]


def test_lookups_do_not_move_the_cache(spark, tmp_path):
    name = cache.open_cache(spark, "cache_c", f"{tmp_path}/cache", buckets=8)
    spark.range(2000).select(F.sha2(F.col("id").cast("string"), 256).alias("key"), F.array(F.col("id").cast("float")).alias("embedding")).write.insertInto(name)
    keys = spark.range(500, 3000).repartition(3).select(F.sha2(F.col("id").cast("string"), 256).alias("key"))
    for how, n in (("left_anti", 1000), ("left_semi", 1500), ("inner", 1500)):
        met = cache.lookup(keys, spark.table(name), how)
        assert met.count() == n
        plan = met._jdf.queryExecution().executedPlan().toString()
        # below the cache's scan no exchange is on the way to the join
        tree = plan.split("== Initial Plan ==")[-1].splitlines()
        scan = next(i for i, line in enumerate(tree) if "cache_c" in line)
        depth = len(re.match(r"[\s:|+-]*", tree[scan])[0])
        above = []
        for line in reversed(tree[:scan]):
            here = len(re.match(r"[\s:|+-]*", line)[0])
            if here < depth:
                depth = here
                above.append(line)
                if "SortMergeJoin" in line:
                    break
        assert "SortMergeJoin" in above[-1] and not any("Exchange" in line for line in above), plan


def test_overlaps_equal_all_pairs(spark):
    rng = random.Random(4)
    boxes = []
    for i in range(400):
        x, y = rng.uniform(-50, 50), rng.uniform(-50, 50)
        w, h = rng.choice([(0, 3), (2, 2), (9, 4), (60, 1), (30, 40)])
        boxes.append((i % 3 if i % 50 else None, i, x, y, x + w, y + h))
    boxes += [(0, 900, 5.0, 5.0, 1.0, 9.0), (0, 901, None, 1.0, 2.0, 3.0), (0, 902, 0.0, 0.0, 10.0, 10.0), (0, 903, 10.0, 0.0, 20.0, 10.0), (0, 904, 0.0, 0.0, 10.0, 10.0)]
    df = spark.createDataFrame(boxes, "sheet int, id int, x1 double, y1 double, x2 double, y2 double")
    want = {}
    for p, q in itertools.product(boxes, boxes):
        if p[0] is not None and p[0] == q[0] and None not in p and None not in q and p[4] >= p[2] and q[4] >= q[2]:
            shared = max(0, min(p[4], q[4]) - max(p[2], q[2])) * max(0, min(p[5], q[5]) - max(p[3], q[3]))
            if shared > 0:
                want[p[0], p[1], q[1]] = round(shared / ((p[4] - p[2]) * (p[5] - p[3]) + (q[4] - q[2]) * (q[5] - q[3]) - shared), 6)
    for size in (3.0, 25.0, 500.0):
        got = spatial.overlapping(df, df, "sheet", size).collect()
        assert {(r.sheet, r.a, r.b): round(r.iou, 6) for r in got} == want and len(got) == len(want)


def test_greedy_matches_equal_a_sorted_walk(spark):
    rng = random.Random(5)
    pairs = sorted({(s, a, b): rng.choice([0.2, 0.5, 0.5, 0.9, rng.random()]) for s in range(4) for a in range(12) for b in range(15) if rng.random() < 0.3}.items())
    df = spark.createDataFrame([(*k, v) for k, v in pairs], "sheet int, a int, b int, iou double")
    taken, want = set(), set()
    for (s, a, b), iou in sorted(pairs, key=lambda p: (-p[1], p[0][1], p[0][2])):
        if not {(s, "a", a), (s, "b", b)} & taken:
            taken |= {(s, "a", a), (s, "b", b)}
            want.add((s, a, b))
    assert {(r.sheet, r.a, r.b) for r in spatial.greedy_matches(df, "sheet").collect()} == want
    assert spatial.greedy_matches(df.filter("a < 0"), "sheet").collect() == []


def test_malformed_records_are_kept_and_counted(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"k": 1, "d": {"os": "x"}}\n\n{"k": \nnot json\n[1, 2]\n{"k": "2"}\n')
    good = readers.read_records(spark, f"{tmp_path}/log.jsonl", f"{tmp_path}/bad")
    bad = spark.read.parquet(f"{tmp_path}/bad").collect()
    assert good.count() == 3 and sorted(r.line for r in bad) == ["not json", '{"k": '] and all(r.file.endswith("log.jsonl") for r in bad)
    assert sorted(r.k or 0 for r in good.select(F.try_variant_get("record", "$.k", "int").alias("k")).collect()) == [0, 1, 2]
    df = spark.createDataFrame([(1, None), (2, "{}"), (3, "")], "id int, props string")
    kept, broken = readers.parse_records(df, "props")
    assert {r.id for r in kept.collect()} == {1, 2} and [r.id for r in broken.collect()] == [3] and "record" not in broken.columns
