"""Readers: nested JSON, JSON lines, file inventories, sidecar texts, CSV, caches, metric documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill import schemas
from corpusmill.functions.text import key_from_stem, strip


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path or glob exists, in any file system that Spark reads."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(place)
    return found is not None and len(found) > 0


def optional_table(spark: SparkSession, path: str) -> DataFrame | None:
    """A Parquet table, or None when it is absent."""
    return spark.read.parquet(path) if path_exists(spark, path) else None


def flatten_articles(articles: DataFrame) -> DataFrame:
    """One row for each image with a url, of articles with a pmcid; ids are stripped, a null caption becomes empty.

    Images are structs, or JSON texts, of which those that are no objects are left out.
    """
    image = F.from_json("i", schemas.IMAGE) if dict(articles.dtypes)["images"] == "array<string>" else F.col("i")
    each = articles.select(strip(F.col("pmcid")).alias("pmcid"), "article_url", F.explode("images").alias("i")).withColumn("i", image)
    out = each.select("pmcid", "article_url", strip(F.col("i.url")).alias("url"), F.coalesce("i.caption", F.lit("")).alias("caption"), F.col("i.label").alias("label"))
    return out.filter("pmcid <> '' and url <> ''")


def read_articles(spark: SparkSession, path: str) -> DataFrame:
    """Figures from a nested JSON export (an array of articles); raises ValueError when there is none.

    Images that are no objects are left out; the others of their article stay.
    """
    out = flatten_articles(spark.read.schema(schemas.ARTICLES).option("multiLine", True).json(path))
    if out.isEmpty():
        raise ValueError(f"no figures in {path}")
    return out


def read_download_log(spark: SparkSession, path: str) -> DataFrame:
    """Successful records of a JSON-lines log; blank and malformed lines and run headers are left out, a missing file is empty."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], schemas.DOWNLOADS)
    log = spark.read.schema(schemas.DOWNLOADS).option("mode", "DROPMALFORMED").json(path)
    return log.filter("ok and coalesce(type, '') <> 'run_header'")


def parse_records(df: DataFrame, column: str, name: str = "record") -> tuple[DataFrame, DataFrame]:
    """(``df`` with the JSON text of ``column`` as a VARIANT, rows whose text is malformed): together all rows of ``df``.

    A null text is a null record and no fault.  The malformed rows keep their text, so they can be written to a
    quarantine table and read again.
    """
    parsed = df.withColumn(name, F.try_parse_json(column))
    broken = F.col(column).isNotNull() & F.col(name).isNull()
    return parsed.filter(~broken), parsed.filter(broken).drop(name)


def read_records(spark: SparkSession, path: str, quarantine: str) -> DataFrame:
    """(record) of every well-formed line of JSON lines, as a VARIANT; (file, line) of the others are appended to ``quarantine``.

    Blank lines are no records.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line")).filter("trim(line) <> ''")
    good, broken = parse_records(lines, "line")
    broken.write.mode("append").parquet(quarantine)
    return good.select("record")


def file_inventory(spark: SparkSession, root: str) -> DataFrame:
    """(path, label, pmcid, filename_stem) of all files below a folder; the label is the parent's name.

    Only the listing is read, never the contents.
    """
    paths = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path")
    return inventory_columns(paths)


def inventory_columns(paths: DataFrame) -> DataFrame:
    name = F.element_at(F.split("path", "/"), -1)
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    return paths.select("path", F.try_element_at(F.split("path", "/"), F.lit(-2)).alias("label"), key_from_stem(stem).alias("pmcid"), stem.alias("filename_stem"))


def read_sidecars(spark: SparkSession, folder: str) -> DataFrame:
    """(filename_stem, caption_text) from one text file for each stem."""
    texts = spark.read.text(folder, wholetext=True).select(F.col("_metadata.file_name").alias("name"), "value")
    return texts.select(F.regexp_replace("name", r"\.[^.]*$", "").alias("filename_stem"), F.col("value").alias("caption_text"))


def attach_sidecar(df: DataFrame, texts: DataFrame, on: str = "filename_stem") -> DataFrame:
    """``df`` with the text of its stem, null when there is no file."""
    return df.join(texts, on, "left")


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV table under a fixed schema; NaN in numbers becomes null."""
    df = spark.read.schema(schema).csv(path, header=True)
    floats = {c for c, t in df.dtypes if t in ("double", "float")}
    return df.select(*(F.when(~F.isnan(c), F.col(c)).alias(c) if c in floats else F.col(c) for c in df.columns))


def embed_missing(requests: DataFrame, cache: DataFrame | None, encode: Callable[[DataFrame], DataFrame], key: str = "text") -> DataFrame:
    """(key, embedding) for all requested keys: cached ones are reused, only the others are encoded."""
    wanted = requests.select(key).distinct()
    if cache is None:
        return encode(wanted)
    hits = cache.join(wanted, key, "left_semi").select(key, "embedding")
    return hits.unionByName(encode(wanted.join(cache, key, "left_anti")).select(key, "embedding"))


def first_directory_tables(listing: DataFrame, directories: list[str]) -> DataFrame:
    """(stem, path): of files with one stem the one whose directory comes first in the list."""
    at = F.array_position(F.array(*(F.lit(d) for d in directories)), F.regexp_extract("path", "^(.*)/[^/]*$", 1))
    named = listing.select("path", F.regexp_extract("path", r"([^/]*?)(\.[^./]*)?$", 1).alias("stem"), at.alias("_rank")).filter("_rank > 0")
    return named.groupBy("stem").agg(F.min_by("path", F.struct("_rank", "path")).alias("path"))


def read_metric_documents(spark: SparkSession, glob: str) -> DataFrame:
    """The union of JSON documents with their file names, missing fields null."""
    return spark.read.option("multiLine", True).json(glob).withColumn("file", F.col("_metadata.file_name"))


def nested_get(document: Column, path: str, default: str | None = None) -> Column:
    """A value inside a JSON text by its path, or the default."""
    return F.coalesce(F.get_json_object(document, path), F.lit(default))


def wanted_members(listing: DataFrame, wanted: DataFrame, key: str = "name") -> tuple[DataFrame, DataFrame]:
    """(members to extract, wanted names that the archive lacks)."""
    return listing.join(wanted.select(key), key, "left_semi"), wanted.join(listing.select(key), key, "left_anti")


def safe_members(listing: DataFrame, name: str = "name") -> DataFrame:
    """Archive members whose path stays below the target folder."""
    parts = F.split(name, "[/\\\\]")
    return listing.filter(~F.startswith(F.col(name), F.lit("/")) & ~F.array_contains(parts, "..") & ~F.col(name).rlike("^[A-Za-z]:"))


def latest_backup(listing: DataFrame, name: str = "name") -> DataFrame:
    """(name) of the newest stamped folder: the greatest name."""
    return listing.agg(F.max(name).alias(name))


def resolve_paths(df: DataFrame, files: DataFrame, stored: str, alternatives: list) -> DataFrame:
    """``df`` with ``resolved``: the first of the stored path and the alternatives (columns) that exists."""
    candidates = F.array(F.col(stored), *alternatives)
    each = df.withColumn("_id", F.xxhash64(*df.columns)).select("_id", F.posexplode(candidates).alias("_place", "_path")).distinct()
    hit = each.join(files.select(F.col("path").alias("_path")), "_path").groupBy("_id").agg(F.min_by("_path", "_place").alias("resolved"))
    return df.withColumn("_id", F.xxhash64(*df.columns)).join(hit, "_id", "left").drop("_id")


def last_versions(df: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """The last row of each key by a sequence column."""
    turn = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(seq)))
    return df.withColumn("_turn", turn).filter("_turn = 1").drop("_turn")
