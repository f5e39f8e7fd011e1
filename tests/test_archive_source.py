import io
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from corpusmill.sources import archive_source


@pytest.fixture
def folder(spark, tmp_path):
    archive_source.register(spark)
    with zipfile.ZipFile(tmp_path / "many.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.mkdir("d")
        for i in range(500):
            z.writestr(f"d/{i}.txt", f"text {i} " * (i % 40))
        z.writestr("../out.txt", "no")
        z.writestr("large.bin", b"x" * 2000)
    with tarfile.open(tmp_path / "some.tar.gz", "w:gz") as t:
        for i in range(5):
            info = tarfile.TarInfo(f"{i}.txt")
            info.size = 3
            t.addfile(info, io.BytesIO(b"abc"))
    (tmp_path / "broken.zip").write_bytes(b"PK\x05\x06 and nothing")
    zipfile.ZipFile(tmp_path / "none.zip", "w").close()
    return tmp_path


def read(spark, path, **options):
    return spark.read.format("archive").options(**options).load(str(path))


def test_one_zip_is_read_by_many_tasks(spark, folder):
    df = read(spark, folder / "many.zip", split_bytes=2000, max_member=1900)
    assert df.rdd.getNumPartitions() > 10
    rows = {r.name: r for r in df.collect()}
    assert len(rows) == 502 == df.count()
    assert all(bytes(rows[f"d/{i}.txt"].content).decode() == f"text {i} " * (i % 40) for i in range(500))
    assert (rows["../out.txt"].safe, rows["../out.txt"].content, rows["../out.txt"].error) == (False, None, "unsafe name")
    assert rows["large.bin"].content is None and rows["large.bin"].error == "above 1900 bytes"
    used = {r.p for r in df.select(F.spark_partition_id().alias("p")).collect()}
    assert len(used) > 5  # each of them read a part


def test_folders_tars_and_broken_archives(spark, folder):
    by_file = {r.path.rsplit("/", 1)[1]: r for r in read(spark, folder).groupBy("path").agg(F.count("name").alias("n"), F.max("error").alias("error")).collect()}
    assert by_file["many.zip"].n == 502 and by_file["some.tar.gz"].n == 5 and "none.zip" not in by_file
    assert by_file["broken.zip"].n == 0 and by_file["broken.zip"].error
    assert read(spark, folder / "some.tar.gz", split_bytes=10).rdd.getNumPartitions() == 1
    assert read(spark, folder / "many.zip", content="false").filter("content is not null").count() == 0


def test_names_reach_the_reader(spark, folder):
    reader = archive_source.ArchiveReader({"path": str(folder / "many.zip"), "split_bytes": "1000000"})
    kept = list(reader.pushFilters([archive_source.In(("name",), ("d/1.txt", "d/7.txt", "x")), archive_source.EqualTo(("size",), 3)]))
    assert [f.attribute for f in kept] == [("size",)]
    assert [r[1] for p in reader.partitions() for r in reader.read(p)] == ["d/1.txt", "d/7.txt"]
    assert [r.name for r in read(spark, folder / "many.zip").filter("name = 'd/3.txt'").collect()] == ["d/3.txt"]


def test_written_archives_read_back(spark, tmp_path):
    archive_source.register(spark)
    df = spark.range(300).select(F.concat(F.lit("n/"), "id").alias("name"), F.repeat(F.col("id").cast("string"), 20).alias("text")).repartition(3)
    written = archive_source.write_archives(df, f"{tmp_path}/zips", "name", "text").collect()
    assert len(written) == 3 and sum(r.members for r in written) == 300
    back = read(spark, f"{tmp_path}/zips", split_bytes=3000).select("name", F.col("content").cast("string").alias("text"))
    assert back.exceptAll(df).isEmpty() and back.count() == 300
