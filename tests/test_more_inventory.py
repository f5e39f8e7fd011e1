"""Detections, archives, backups, joins by split, track and position."""

import io
import random
import subprocess
import sys
import tarfile
import zipfile
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from corpusmill.functions.text import iso_stamp
from corpusmill.operators import boxes, dedup, joins, sampling, split
from corpusmill.sources import archives


def iou(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    shared = max(w, 0) * max(h, 0)
    return shared / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - shared)


def brute(found, truth, least):
    taken, marks = set(), []
    pairs = sorted((-c, i, b, -iou(box, t), k) for i, b, c, *box in found for j, k, *t in truth if i == j and iou(box, t) >= least)
    done = set()
    for _, i, b, _, k in pairs:
        if (i, b) not in done and (i, k) not in taken:
            done.add((i, b))
            taken.add((i, k))
    points, seen, right = [], 0, 0
    for c in sorted({f[2] for f in found}, reverse=True):
        step = [f for f in found if f[2] == c]
        seen, h = seen + len(step), sum((f[0], f[1]) in done for f in step)
        right += h
        points.append((right / seen, h))
    area = sum(max(p for p, _ in points[k:]) * h for k, (_, h) in enumerate(points)) / len(truth)
    return len(done), len(done) / len(found), len(done) / len(truth), area


def test_detection_metrics(spark):
    rng = random.Random(1)
    truth, found = [], []
    for i in range(12):
        for k in range(rng.randint(1, 6)):
            x, y = rng.random() * 4, rng.random() * 4
            truth.append((i, k, x, y, x + 1, y + 1))
            for _ in range(rng.randint(0, 3)):
                dx, dy = rng.uniform(-0.3, 0.3), rng.uniform(-0.3, 0.3)
                found.append((i, len(found), round(rng.random(), 1), x + dx, y + dy, x + 1 + dx, y + 1 + dy))
    sides = "x1 double, y1 double, x2 double, y2 double"
    f = spark.createDataFrame(found, f"image int, box int, confidence double, {sides}")
    t = spark.createDataFrame(truth, f"image int, box int, {sides}")
    got = {r.threshold: r for r in boxes.detection_metrics(f, t, thresholds=(0.5, 0.75)).collect()}
    for least, r in got.items():
        hits, precision, recall, area = brute(found, truth, least)
        assert r.hits == hits and (r.precision, r.recall, r.average_precision) == pytest.approx((precision, recall, area))
    none = boxes.detection_metrics(f.limit(0), t).first()
    assert (none.n_found, none.precision, none.recall, none.average_precision) == (0, None, 0.0, 0.0)
    assert boxes.detection_metrics(f, t.limit(0)).first().average_precision is None


def test_archives(spark, tmp_path):
    files = {"a/one.txt": b"1", "a/b/two.txt": b"22", "three.txt": b"333"}
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        for n, d in files.items():
            z.writestr(n, d)
    with tarfile.open(tmp_path / "y.tar.gz", "w:gz") as t:
        for n, d in {**files, "../evil.txt": b"0"}.items():
            info = tarfile.TarInfo(n)
            info.size = len(d)
            t.addfile(info, io.BytesIO(d))
    (tmp_path / "bad.zip").write_bytes(b"junk")
    paths = spark.createDataFrame([(str(tmp_path / n),) for n in ("x.zip", "y.tar.gz", "bad.zip", "none.zip")] + [(None,)], "path string")
    rows = archives.archive_members(paths, content=True).collect()
    whole = {(r.path.rsplit("/", 1)[1], r.name): (r.safe, r.content and bytes(r.content)) for r in rows if not r.error}
    assert whole == {("x.zip", n): (True, d) for n, d in files.items()} | {("y.tar.gz", n): (True, d) for n, d in files.items()} | {("y.tar.gz", "../evil.txt"): (False, None)}
    assert sorted(r.path.rsplit("/", 1)[1] for r in rows if r.error) == ["bad.zip", "none.zip"]
    some = archives.archive_members(paths, wanted=["two.txt"]).filter("error is null").collect()
    assert [(r.name, r.size, r.content) for r in some] == [("a/b/two.txt", 2, None)] * 2
    out = tmp_path / "out"
    assert {r.name for r in archives.extract(spark, str(tmp_path / "x.zip"), str(out), ["one.txt", "three.txt"]).collect()} == {"a/one.txt", "three.txt"}
    assert (out / "a/one.txt").read_bytes() == b"1" and not (out / "a/b").exists() and (out / archives.MARKER).exists()
    with pytest.raises(ValueError, match="leave the folder"):
        archives.extract(spark, str(tmp_path / "y.tar.gz"), str(tmp_path / "no"))
    with pytest.raises(FileNotFoundError, match="not in the archive"):
        archives.extract(spark, str(tmp_path / "x.zip"), str(tmp_path / "no"), ["four.txt"])
    assert not (tmp_path / "no").exists()
    listing = spark.createDataFrame([("z/data/images/1.png",), ("data/images/2.png",), ("q/r.txt",)], "name string")
    assert archives.data_root(listing, "images") == "data" and archives.data_root(listing, "none") is None
    first = archives.backup(str(out), str(tmp_path / "kept"), datetime(2024, 1, 2))
    (out / "three.txt").write_bytes(b"new")
    archives.backup(str(out), str(tmp_path / "kept"), datetime(2024, 1, 3))
    assert first.endswith("backup_20240102_000000")
    archives.restore_latest(str(tmp_path / "kept"), str(tmp_path / "back"))
    assert (tmp_path / "back/three.txt").read_bytes() == b"new"


def test_joins_and_stamp(spark):
    records = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "h string, k int")
    listed = spark.createDataFrame([("a", 1, "train"), ("c", 9, "val")], "h string, k int, split string")
    found, missing = joins.split_records(records, listed, ["h", "k"])
    assert [tuple(r) for r in found.collect()] == [("a", 1, "train")] and sorted((r.k for r in missing.collect())) == [2, 3]
    side = joins.side_by_position(spark.range(5).toDF("x"), spark.createDataFrame([(c,) for c in "cab"], "y string"), ["x"], ["y"])
    assert sorted(map(tuple, side.collect())) == [(0, "a"), (1, "b"), (2, "c"), (3, None), (4, None)]
    with pytest.raises(ValueError, match="columns of both"):
        joins.side_by_position(records, records, ["h"], ["h"])
    stamp = spark.range(1).select(iso_stamp(F.lit("2024-05-06 07:08:09").cast("timestamp")).alias("t"), iso_stamp().alias("now")).first()
    assert stamp.t == "2024-05-06T07:08:09" and len(stamp.now) == 19


def test_seeds_hot_groups_and_backfill(spark):
    df = spark.range(400).select(F.col("id").alias("g"), (F.col("id") % 7).cast("string").alias("s"))
    parts = [{r.g: r.split for r in split.grouped_split(df, "g", seed=s).collect()} for s in (1, 2, 1)]
    assert parts[0] == parts[2] != parts[1] and [sum(v == "train" for v in p.values()) for p in parts] == [320] * 3
    hot = spark.range(500).select(F.lit("h").alias("hash"), "id").union(spark.createDataFrame([("one", 1), (None, 5), (None, 6)], "hash string, id long"))
    assert [tuple(r) for r in dedup.exact_groups(hot, "hash", "id").collect()] == [("h", 500, [0, 1, 2, 3, 4])]
    picked = sampling.stratified_backfill(df, "s", 3, 30, "g").collect()
    per = {k: sum(r.s == k for r in picked) for k in map(str, range(7))}
    assert len(picked) == 30 and min(per.values()) >= 3
    assert sorted(df.columns) == sorted(picked[0].asDict())


def test_entry_without_packages_of_the_part():
    code = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name in ("public_tokenizers", "sentencepiece"):
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert "curation_summary" in e.queries() and not any(q.startswith("op") for q in e.queries()) and "pipeline" not in e.oracle_sql()
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=str(__import__("pathlib").Path(__file__).parents[1]))
