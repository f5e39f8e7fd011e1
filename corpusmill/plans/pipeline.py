"""Stage runner: ordered builders, resume, memoised results.

Results can be named by a digest of what they follow from: the stage's plan, its parameters and the files that it reads.
The files of a stage's inputs carry the digests of the stages before, so a changed input, parameter or plan builds its
stage and those behind it again, and nothing else.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from corpusmill.sources.readers import path_exists


@dataclass(frozen=True)
class Stage:
    """A labelled step; ``track`` limits it to one track, optional steps can be skipped."""

    label: str
    build: Callable[[dict[str, DataFrame]], DataFrame]
    optional: bool = False
    track: str | None = None
    params: dict[str, Any] = field(default_factory=dict, hash=False)


def file_marks(df: DataFrame) -> list[tuple[str, int, int]]:
    """(path, length, time of change) of every file that ``df`` reads, as the planner lists them."""
    spark = df.sparkSession
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    marks = []
    for name in sorted(df.inputFiles()):
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(spark.sparkContext._jvm.java.net.URI(name))
        status = path.getFileSystem(conf).getFileStatus(path)
        marks.append((name, status.getLen(), status.getModificationTime()))
    return marks


def plan_digest(df: DataFrame, params: dict[str, Any] | None = None) -> str:
    """A digest of the plan of ``df`` (names of columns included), of ``params`` and of the files it reads.

    The same program gives the same digest in another session.  What the plan does not show has to be in ``params``: the
    code of Python functions, and rows made on the driver.
    """
    conf, width = df.sparkSession.conf, "spark.sql.debug.maxToStringFields"
    held = conf.get(width)
    conf.set(width, str(2**31 - 1))  # wide plans would be printed in part
    try:
        plan = df._jdf.queryExecution().optimizedPlan().canonicalized().toString()
    finally:
        conf.set(width, held)
    plan = re.sub(r"#\d+L?", "#", plan)
    plan = re.sub(r"(@|0x)[0-9a-f]{6,16}\b", "", plan)
    parts = [plan, df.schema.json(), json.dumps(params or {}, sort_keys=True, default=repr), json.dumps(file_marks(df))]
    return hashlib.sha256("\0".join(parts).encode()).hexdigest()


def run_digested(spark: SparkSession, stages: list[Stage], root: str) -> dict[str, DataFrame]:
    """The results by label, each a table at ``root/label/digest``; only stages whose digest has no whole table are built.

    Tables of other digests stay, so going back to an earlier parameter builds nothing.
    """
    results: dict[str, DataFrame] = {}
    for stage in stages:
        plan = stage.build(results)
        place = f"{root}/{stage.label}/{plan_digest(plan, stage.params)}"
        results[stage.label] = memoised(spark, place, lambda p=plan: p)
    return results


def memoised(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table at ``path``; built and written first unless a complete one is there."""
    if not path_exists(spark, f"{path}/_SUCCESS"):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def select_stages(stages: list[Stage], start: str | None = None, skip_optional: bool = False, track: str = "both") -> list[Stage]:
    """The stages to run: from the first whose label begins with ``start``; raises ValueError when none does."""
    at = 0
    if start is not None:
        at = next((i for i, s in enumerate(stages) if s.label.startswith(start)), -1)
        if at < 0:
            raise ValueError(f"no stage begins with {start!r}")
    return [s for s in stages[at:] if not (skip_optional and s.optional) and (track == "both" or s.track in (None, track))]


def run(spark: SparkSession, stages: list[Stage], root: str | None = None, **selection) -> dict[str, DataFrame]:
    """The results by label.  With ``root`` each is a memoised table there; without, the plans stay lazy.

    The first failure ends the run.
    """
    results: dict[str, DataFrame] = {}
    if root is not None:
        for stage in stages:  # results of earlier runs, for a run that starts later
            if path_exists(spark, f"{root}/{stage.label}/_SUCCESS"):
                results[stage.label] = spark.read.parquet(f"{root}/{stage.label}")
    for stage in select_stages(stages, **selection):
        if root is None:
            results[stage.label] = stage.build(results)
        else:
            results[stage.label] = memoised(spark, f"{root}/{stage.label}", lambda s=stage: s.build(results))
    return results
