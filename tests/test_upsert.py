import random

import pytest

from corpusmill.plans.seams import score
from corpusmill.streaming import upsert

SCHEMA = "k long, seq long, v string"
KEYS, ORDER = ["k"], ["seq"]


def feed(spark, tmp_path, seed=1):
    rng = random.Random(seed)
    rows = [(rng.randrange(40) if rng.random() > 0.05 else None, rng.choice([None, *range(30)]), rng.choice(["a", "b", None])) for _ in range(600)]
    folder = str(tmp_path / "in")
    spark.createDataFrame(rows, SCHEMA).repartition(12).write.parquet(folder)
    greatest = {}
    for row in rows:
        place = tuple((x is not None, x if x is not None else 0) for x in row[1:2]) + ((row[2] is not None, row[2] or ""),)
        if row[0] not in greatest or place > greatest[row[0]][0]:
            greatest[row[0]] = (place, row)
    return folder, sorted((r for _, r in greatest.values()), key=repr)


def stream(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)


def table(spark, target, **options):
    return sorted((tuple(r) for r in upsert.current(spark, target, KEYS, ORDER, **options).collect()), key=repr)


@pytest.mark.parametrize("stop", ["before", "after", "merge"])
def test_killed_run_gives_the_rows_of_an_unbroken_one(spark, tmp_path, monkeypatch, stop):
    folder, want = feed(spark, tmp_path)
    target, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    make = upsert.write_batch

    def failing(*args, **options):
        write = make(*args, **options)

        def batch(rows, number):
            if number == 5 and stop == "before":
                raise RuntimeError("killed")
            if number == 5 and stop == "merge":  # the batch is written, the merge half so
                rows.write.mode("overwrite").parquet(f"{target}/batches/5")
                rows.write.mode("overwrite").parquet(f"{target}/bases/5")
                (tmp_path / "out" / "bases" / "5" / "_SUCCESS").unlink()
                raise RuntimeError("killed")
            write(rows, number)
            if number == 5 and stop == "after":  # written, but not in the stream's log
                raise RuntimeError("killed")

        return batch

    monkeypatch.setattr(upsert, "write_batch", failing)
    with pytest.raises(Exception, match="killed"):
        upsert.upsert_stream(stream(spark, folder), target, checkpoint, KEYS, ORDER, merge_every=3)
    monkeypatch.setattr(upsert, "write_batch", make)
    upsert.upsert_stream(stream(spark, folder), target, checkpoint, KEYS, ORDER, merge_every=3)
    assert table(spark, target) == want
    upsert.upsert_stream(stream(spark, folder), target, checkpoint, KEYS, ORDER, merge_every=3)  # nothing new
    assert table(spark, target) == want
    assert len(list((tmp_path / "out" / "bases").glob("[0-9]*"))) == 2 and len(list((tmp_path / "out" / "batches").glob("[0-9]*"))) <= 6
    assert table(spark, target, deleted="v = 'a'") == [r for r in want if r[2] != "a"]


def test_scoring_resumes(spark, tmp_path):
    folder, want = feed(spark, tmp_path, 2)
    target, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")

    def answers(rows):
        return score(rows, lambda part: [f"{k}" for k in part["k"].astype("Int64")])

    upsert.upsert_stream(stream(spark, folder), target, checkpoint, KEYS, ORDER, answers)
    got = sorted((tuple(r) for r in upsert.current(spark, target, KEYS, ORDER).collect()), key=repr)
    assert [r[:3] for r in got] == want and all(r[3] == ("<NA>" if r[0] is None else str(r[0])) for r in got)


def test_no_batch(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        upsert.current(spark, str(tmp_path / "none"), KEYS, ORDER)
