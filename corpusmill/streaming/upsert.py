"""A table of the last write of each key, fed by a stream that may stop anywhere.

Every micro-batch is reduced to the last write of each of its keys and written to a folder named by the batch's number,
so a batch that is repeated after a failure replaces what it wrote.  Every few batches all folders are merged into a
base.  A reader takes the newest whole base and the whole folders after it, and keeps the greatest write of each key.
The number of folders is bounded by the merges, a merge costs the table's size once in so many batches, and no row
passes the driver.

The order of writes is that of ``order`` (null first), then that of all other columns, so repeated and late writes
change nothing whatever batch they come in.  Deletions are kept as writes, since an older write may still come.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.plans.scratch import _path_and_files
from corpusmill.sources.readers import path_exists

MERGE_EVERY = 10


def last_writes(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The greatest row of each key (a null key is one too) by ``order`` and then by all other columns; partial aggregation, no sort."""
    rest = [c for c in rows.columns if c not in keys and c not in order]
    greatest = rows.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("it"))
    return greatest.select(*(F.col(c) if c in keys else F.col(f"it.{c}").alias(c) for c in rows.columns))


def _numbers(spark: SparkSession, folder: str) -> list[int]:
    """The numbers of the whole batches below ``folder``, ascending."""
    if not path_exists(spark, f"{folder}/*/_SUCCESS"):
        return []
    path, files = _path_and_files(spark, folder)
    names = [s.getPath().getName() for s in files.listStatus(path)]
    return sorted(int(n) for n in names if n.isdigit() and path_exists(spark, f"{folder}/{n}/_SUCCESS"))


def _folders(spark: SparkSession, target: str, upto: int | None = None) -> list[str]:
    """The newest base and the batches after it, not beyond ``upto``."""
    bases = [n for n in _numbers(spark, f"{target}/bases") if upto is None or n <= upto]
    after = bases[-1] if bases else -1
    batches = [n for n in _numbers(spark, f"{target}/batches") if n > after and (upto is None or n <= upto)]
    return [f"{target}/bases/{n}" for n in bases[-1:]] + [f"{target}/batches/{n}" for n in batches]


def write_batch(target: str, keys: list[str], order: list[str], transform: Callable[[DataFrame], DataFrame] | None = None, merge_every: int = MERGE_EVERY):
    """The function for ``foreachBatch``: writes batch ``number`` and merges when it is due; repeating it changes nothing."""

    def write(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        new = last_writes(transform(rows) if transform else rows, keys, order)
        new.write.mode("overwrite").parquet(f"{target}/batches/{number}")
        if (number + 1) % merge_every == 0:
            merged = last_writes(spark.read.schema(new.schema).parquet(*_folders(spark, target, number)), keys, order)
            if not path_exists(spark, f"{target}/bases/{number}/_SUCCESS"):
                merged.write.mode("overwrite").parquet(f"{target}/bases/{number}")
            _forget(spark, target)

    return write


def _forget(spark: SparkSession, target: str) -> None:
    """Delete what lies before the last base but one: readers that began before the last merge still find theirs."""
    bases = _numbers(spark, f"{target}/bases")
    if len(bases) < 2:
        return
    for kind, end in (("bases", bases[-2] - 1), ("batches", bases[-2])):
        for n in _numbers(spark, f"{target}/{kind}"):
            if n <= end:
                path, files = _path_and_files(spark, f"{target}/{kind}/{n}")
                files.delete(path, True)


def upsert_stream(stream: DataFrame, target: str, checkpoint: str, keys: list[str], order: list[str], transform: Callable[[DataFrame], DataFrame] | None = None, merge_every: int = MERGE_EVERY) -> None:
    """Feed what the stream has and earlier calls have not taken into the table at ``target``, and stop.

    ``transform`` works on each micro-batch before the upsert, such as a model's scoring; the source's options
    (``maxFilesPerTrigger``, ``maxBytesPerTrigger``) say how much a stop can cost.
    """
    write = write_batch(target, keys, order, transform, merge_every)
    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def current(spark: SparkSession, target: str, keys: list[str], order: list[str], deleted: str | None = None) -> DataFrame:
    """The last write of each key in the table at ``target``, without those for which the condition ``deleted`` holds.

    Raises FileNotFoundError when no batch has been written.
    """
    folders = _folders(spark, target)
    if not folders:
        raise FileNotFoundError(target)
    rows = last_writes(spark.read.parquet(*folders), keys, order)
    return rows.filter(f"not coalesce({deleted}, false)") if deleted else rows
