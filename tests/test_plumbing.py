import json
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from corpusmill.plans import pipeline, seams
from corpusmill.sources import readers, writers
from corpusmill.streaming import incremental


def test_articles(spark, tmp_path):
    data = [
        {"pmcid": " P1 ", "article_url": "u", "images": [{"url": "i1", "caption": None, "label": "x"}, {"url": " ", "caption": "c"}, {"url": "i2", "caption": "c", "label": "y"}]},
        {"pmcid": "", "images": [{"url": "i3"}]},
        {"pmcid": "P2", "images": None},
        {"pmcid": "P3", "images": ["junk", {"url": "i4", "caption": "c"}, 5, None, []]},
    ]
    (tmp_path / "a.json").write_text(json.dumps(data))
    got = sorted((r.pmcid, r.url, r.caption) for r in readers.read_articles(spark, str(tmp_path / "a.json")).collect())
    assert got == [("P1", "i1", ""), ("P1", "i2", "c"), ("P3", "i4", "c")]
    (tmp_path / "b.json").write_text("[]")
    with pytest.raises(ValueError, match="no figures"):
        readers.read_articles(spark, str(tmp_path / "b.json"))


def test_download_log(spark, tmp_path):
    lines = ['{"type": "run_header", "ok": true}', "", "{broken", '{"ok": true, "pmcid": "P"}', '{"ok": false, "pmcid": "Q"}']
    (tmp_path / "log.jsonl").write_text("\n".join(lines))
    assert [r.pmcid for r in readers.read_download_log(spark, str(tmp_path / "log.jsonl")).collect()] == ["P"]
    assert readers.read_download_log(spark, str(tmp_path / "none.jsonl")).count() == 0


def test_inventory_and_sidecars(spark, tmp_path):
    for name in ("x/0001-PMC1__f.jpg", "y/0002-PMC2.png"):
        (tmp_path / "images" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "images" / name).write_bytes(b"x")
    files = readers.file_inventory(spark, str(tmp_path / "images"))
    assert sorted((r.label, r.pmcid, r.filename_stem) for r in files.collect()) == [("x", "PMC1", "0001-PMC1__f"), ("y", None, "0002-PMC2")]
    (tmp_path / "captions").mkdir()
    (tmp_path / "captions/0001-PMC1__f.txt").write_text("two\nlines")
    joined = readers.attach_sidecar(files, readers.read_sidecars(spark, str(tmp_path / "captions")))
    assert {r.filename_stem: r.caption_text for r in joined.collect()} == {"0001-PMC1__f": "two\nlines", "0002-PMC2": None}


def test_caches_and_listings(spark):
    cache = spark.createDataFrame([("a", [1.0])], "text string, embedding array<double>")
    asked = []

    def encode(df):
        asked.extend(r.text for r in df.collect())
        return df.withColumn("embedding", F.array(F.lit(2.0)))

    wanted = spark.createDataFrame([("a",), ("b",), ("b",)], "text string")
    assert {r.text: r.embedding for r in readers.embed_missing(wanted, cache, encode).collect()} == {"a": [1.0], "b": [2.0]} and asked == ["b"]
    listing = spark.createDataFrame([("d2/m.parquet",), ("d1/m.parquet",), ("d2/n.parquet",)], "path string")
    assert {r.stem: r.path for r in readers.first_directory_tables(listing, ["d1", "d2"]).collect()} == {"m": "d1/m.parquet", "n": "d2/n.parquet"}
    members = spark.createDataFrame([("a/b",), ("../x",), ("/etc",), ("a/../../y",), ("a..b",)], "name string")
    assert sorted(r.name for r in readers.safe_members(members).collect()) == ["a..b", "a/b"]


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("a", "train", ["x", "y"]), ("b", "test", [])], "k string, split string, l array<string>")
    writers.write_splits(df, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).filter("split = 'test'").count() == 1
    writers.write_csv(df, str(tmp_path / "c"))
    writers.write_csv(df, str(tmp_path / "c"), mode="append")
    assert spark.read.csv(str(tmp_path / "c"), header=True).count() == 4
    assert writers.report_table(df, ["k", "split"], [F.col("k")]).splitlines()[-1] == "| b | test |"
    assert r"a & train \\" in writers.report_table(df, ["k", "split"], [F.col("k")], style="latex")
    boxes = spark.createDataFrame([("i", 0, 0.5, 0.5, 0.25, 0.125)], "image string, box_no int, cx double, cy double, bw double, bh double")
    assert writers.annotation_lines(boxes, "image").first().content == "0 0.500000 0.500000 0.250000 0.125000"


def test_pipeline(spark, tmp_path):
    ran = []

    def stage(label, build, **options):
        def logged(results):
            ran.append(label)
            return build(results)

        return pipeline.Stage(label, logged, **options)

    stages = [stage("01a", lambda r: spark.range(5)), stage("01b", lambda r: r["01a"].filter("id > 2"), optional=True), stage("02", lambda r: r["01a"].filter("id = 1"), track="x")]
    assert pipeline.run(spark, stages, str(tmp_path))["01b"].count() == 2
    assert ran == ["01a", "01b", "02"]
    pipeline.run(spark, stages, str(tmp_path))
    assert ran == ["01a", "01b", "02"]
    assert [s.label for s in pipeline.select_stages(stages, start="01", skip_optional=True, track="y")] == ["01a"]
    with pytest.raises(ValueError, match="no stage"):
        pipeline.select_stages(stages, start="9")


def test_scoring_seam(spark):
    def predict(rows):
        if (rows.x == 3).any():
            raise RuntimeError("boom")
        return [f"p{x}" for x in rows.x]

    df = spark.createDataFrame([(i,) for i in range(5)], "x int").coalesce(1)
    done = df.filter("x = 0")
    got = {r.x: r.prediction for r in seams.resume(df, done, ["x"], predict, batch=3).collect()}
    assert got == {1: "p1", 2: "p2", 3: "[ERROR: boom]", 4: "p4"}


def test_incremental(spark, tmp_path):
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    spark.range(3).write.parquet(source)
    run = lambda: incremental.process_new_files(spark, source, "id long", lambda d: d.withColumn("x", F.col("id") * 2), out, state)
    run()
    spark.range(10, 12).write.mode("append").parquet(source)
    run()
    run()
    assert sorted(r.x for r in spark.read.parquet(out).collect()) == [0, 2, 4, 20, 22]


def test_library_does_not_need_the_training_operators():
    root = Path(__file__).parents[1]
    code = (
        "import sys, importlib.abc\n"
        "class Hide(importlib.abc.MetaPathFinder):\n"
        "    def find_spec(self, name, path, target=None):\n"
        "        if name == 'corpus_pipeline' or name.startswith('corpusmill.llm'):\n"
        "            raise ModuleNotFoundError(name, name=name)\n"
        "sys.meta_path.insert(0, Hide())\n"
        "import __spark_entry__ as e\n"
        "print(len(e.queries()) > 50, any(n.startswith('op') for n in e.queries()))"
    )
    done = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, timeout=120, check=True)
    assert done.stdout.split() == ["True", "False"]
