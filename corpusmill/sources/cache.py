"""A table of embeddings by content, bucketed so that looking up does not move it.

A key is the digest of the encoder's version and the text, so a new encoder never meets old vectors.  The table is
clustered by key: the requests are dealt into its buckets, the table stays where it is, and only texts that it lacks are
encoded and appended.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.plans.scratch import materialize

BUCKETS = 64


def content_key(text: Column, version: str) -> Column:
    """A digest of the encoder's version and a text; null for a null text."""
    return F.sha2(F.concat(F.lit(f"{len(version)}:{version}:"), text), 256)


def open_cache(spark: SparkSession, name: str, path: str, vector: str = "array<float>", buckets: int = BUCKETS) -> str:
    """The name of the cache table at ``path``, which is created when it is new and found again when it is not.

    The number of buckets belongs to the files: open a cache with the number that it was made with.
    """
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} (key STRING, embedding {vector}) USING parquet CLUSTERED BY (key) SORTED BY (key) INTO {buckets} BUCKETS LOCATION '{path}'")
    return name


def lookup(keys: DataFrame, cache: DataFrame, how: str) -> DataFrame:
    """``keys`` joined with the cache by merging its sorted buckets: the cache is neither shuffled nor broadcast."""
    return keys.join(cache.hint("merge"), "key", how)


def embed_cached(requests: DataFrame, cache: str, encode: Callable[[DataFrame], DataFrame], version: str, text: str = "text") -> DataFrame:
    """``requests`` with ``embedding`` and ``was_cached``; texts that the cache lacks are encoded once and appended to it.

    ``encode`` maps (key, text) to (key, embedding).  Equal texts are encoded once, null texts never and stay null.  The
    new vectors are written before they are returned, so a run that stops after that encodes nothing again; two runs at
    once may both append a vector, of which the reader takes one.
    """
    spark = requests.sparkSession
    keyed = requests.withColumn("key", content_key(F.col(text), version))
    wanted = keyed.filter("key is not null").groupBy("key").agg(F.min(text).alias("text"))
    table = spark.table(cache)
    before = lookup(wanted.select("key"), table.select("key"), "left_semi")
    # written first: the table grows below
    before = materialize(before.withColumn("was_cached", F.lit(True)), "cached-keys")
    missing = lookup(wanted, table.select("key"), "left_anti")
    encode(missing).select("key", "embedding").write.insertInto(cache)
    spark.catalog.refreshTable(cache)
    held = lookup(wanted.select("key"), spark.table(cache), "inner").groupBy("key").agg(F.first("embedding").alias("embedding"))
    out = keyed.join(held, "key", "left").join(before, "key", "left").withColumn("was_cached", F.coalesce("was_cached", F.lit(False)))
    return out.drop("key")
