"""Hourly panes with revisions: salted shards against skew before a stateful merger.

Rows come in batches.  A streaming query is started anew for every batch on one
checkpoint and counts rows by pane, an event hour of one kind.  Each Arrow
batch is summed by pane before the shuffle.  Shards are dealt by pane and salt:
they add up partial sums and forward none of them while rows arrive, but once
the batch's rows are through.  So nothing of a shard outlives a batch, and it
needs no state store.  The merger is keyed by pane alone and keeps the totals in
state.  It combines the deltas and decides what is published: totals when they
are due, retractions and replacements of published totals, and the end of the
pane.  A hot pane thus meets in one task only as one row for each salt.  A pane
without rows in a batch is called by the timeout that every live pane keeps.

Time is W, the greatest event time of all earlier batches.  A pane is due when W
is at its end plus 12 hours or beyond, and closed at its end plus 2 days.  W is
one number for each batch, the only thing that reaches the driver; whether a row
is late follows from W alone, so late rows pass shards and merger without touching
state, spread over lanes by their ids.

Each start takes one micro-batch: its rows are moved into the source's folder as
a whole, with a punctuation row that makes the batch exist when it has no other.
Sources, state and results are files below ``spark.checkpoint.dir``, in a folder
of its own for every call, so lost executors cost a repeated micro-batch, and
the sink's log keeps rows from being written twice.

Edge cases: rows without a time are dropped; of rows with one id the smallest
counts (a null id is one id); without an arrival time the event time stands for
it; a null kind is ``none``; values that are null or no finite number are 0
cents; hours may be negative; an empty table runs all batches and gives an empty
result; columns other than those named are ignored, and no text is read but the
kind.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corpusmill.plans.scratch import move, scratch_folder

from ._sql import crc32_sql

BATCHES = 10
HOUR_US, DAY_US = 3_600_000_000, 86_400_000_000
DUE_US, CLOSED_US = 12 * HOUR_US, 2 * DAY_US
SALTS = 4
LATE_LANES = 1024  # a power of two

ROWS = "click_id long, event_us long, kind string, cents long, punctuation boolean"
PARTIAL = pa.schema([("hour", pa.int64()), ("kind", pa.string()), ("salt", pa.int64()), ("late", pa.bool_()), ("click_id", pa.int64()), ("n_rows", pa.int64()), ("cents", pa.int64())])
DELTA = pa.schema([("pane_hour", pa.int64()), ("pane_kind", pa.string()), ("lane", pa.int64()), ("hour", pa.int64()), ("kind", pa.string()), ("click_id", pa.string()), ("n_rows", pa.int64()), ("cents", pa.int64())])
RECORDS = "batch long, hour long, click_id long, n_rows long, cents long, record string, kind string"
TOTALS = "n_rows long, cents long, emitted boolean"


def _micros(column: str) -> Column:
    """Microseconds since 1970 of a timestamp without a zone (one with a zone counts by the session's clock)."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', cast(`{column}` as timestamp_ntz))")


def _floor_div(a: Column, b: int) -> Column:
    return ((a - F.pmod(a, F.lit(b))) / b).cast("long")


def click_batches(clicks: DataFrame, batches: int = BATCHES) -> DataFrame:
    """(batch, click_id, event_us, kind, cents), one row for each click: by arrival day modulo ``batches``, one in five some batches later.

    The event time is moved by as many days as the arrival day, so all batches lie next to each other.
    """
    raw = clicks.filter(F.col("ts").isNotNull()).select("click_id", _micros("ts").alias("ts"), _micros("arrived_at").alias("arrived"), "kind", "value")
    fields = ["ts", "arrived", "kind", "value"]
    once = raw.groupBy("click_id").agg(F.min(F.struct(*fields)).alias("it")).select("click_id", "it.*")
    day = _floor_div(F.coalesce("arrived", "ts"), DAY_US)
    q = F.pmod(day, F.lit(batches))
    held_back = F.greatest(F.coalesce(F.crc32(F.col("click_id").cast("string")), F.lit(0)) % 30 - 23, F.lit(0))
    amount = F.when(F.col("value").isNull() | F.isnan("value") | (F.abs("value") == float("inf")), 0.0).otherwise(F.col("value"))
    return once.select(
        F.least(F.lit(batches - 1), q + held_back).cast("int").alias("batch"),
        "click_id",
        (F.col("ts") - (day - q) * DAY_US).alias("event_us"),
        F.coalesce("kind", F.lit("none")).alias("kind"),
        F.floor(100 * amount + 0.5).cast("long").alias("cents"),
    )


def _sums(table: pa.Table, keys: list[str], sums: list[str]) -> pa.Table:
    return table.group_by(keys).aggregate([(c, "sum") for c in sums]).rename_columns([*keys, *sums])


def _partial_sums(salts: int):
    """Sums of an Arrow batch by pane, each with a salt, and its late rows one by one."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("click_id")
            counted = pa.Table.from_batches([batch]).append_column("n_rows", pa.array([1] * batch.num_rows, pa.int64()))
            timely = counted.filter(pc.invert(batch.column("late"))).group_by(["hour", "kind"]).aggregate([("click_id", "max"), ("n_rows", "sum"), ("cents", "sum")])
            n = timely.num_rows
            salt = [(i or 0) % salts for i in timely["click_id_max"].to_pylist()]
            sums = [timely["hour"], timely["kind"], pa.array(salt, pa.int64()), pa.array([False] * n, pa.bool_()), pa.array([-1] * n, pa.int64()), timely["n_rows_sum"], timely["cents_sum"]]
            yield from pa.Table.from_arrays(sums, schema=PARTIAL).to_batches()
            salt = pa.array([(i or 0) % salts for i in ids.to_pylist()], pa.int64())
            yield from counted.append_column("salt", salt).filter(batch.column("late")).select(PARTIAL.names).cast(PARTIAL).to_batches()

    return rows


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One shard's panes: deltas are held until the batch's rows are through, late rows pass.

    Late rows go to lanes by id and not by pane: those of a hot pane stay spread, and many panes of few late rows make no groups of their own.
    """
    keys, held = ["hour", "kind"], None
    for batch in batches:
        part = pa.Table.from_batches([batch])
        late = part.filter(part["late"])
        n = late.num_rows
        lane = pc.add(pc.bit_wise_and(pc.fill_null(late["click_id"], 0), LATE_LANES - 1), 1)
        yield from pa.Table.from_arrays([pa.array([0] * n, pa.int64()), pa.array([""] * n, pa.string()), lane, late["hour"], late["kind"], late["click_id"].cast(pa.string()), late["n_rows"], late["cents"]], schema=DELTA).to_batches()
        delta = _sums(part.filter(pc.invert(part["late"])), keys, ["n_rows", "cents"])
        held = delta if held is None else _sums(pa.concat_tables([held, delta]), keys, ["n_rows", "cents"])
    if held is not None:
        n = held.num_rows
        yield from pa.Table.from_arrays([held["hour"], held["kind"], pa.array([0] * n, pa.int64()), held["hour"], held["kind"], pa.array(["-1"] * n, pa.string()), held["n_rows"], held["cents"]], schema=DELTA).to_batches()


class Merger:
    """Keyed by pane: combines the shards' deltas and publishes once in a batch.

    Every pane keeps a timeout, which calls it in a batch without rows of its own; a closed pane keeps nothing.
    """

    def __init__(self, batch: int, now_us: int | None, last: bool):
        self.batch, self.now_us, self.last = batch, now_us, last

    def __call__(self, key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        hour, kind, lane = key
        if lane:
            for part in parts:
                yield pd.DataFrame({"batch": self.batch, "hour": part.hour, "click_id": part.click_id, "n_rows": part.n_rows, "cents": part.cents, "record": "late", "kind": part.kind})
            return
        old_n, old_cents, emitted = state.get if state.exists else (0, 0, False)
        n, cents, new = old_n, old_cents, False
        if not state.hasTimedOut:
            for part in parts:
                n, cents, new = n + int(part.n_rows.sum()), cents + int(part.cents.sum()), True
        due, closed = (_reached(self.now_us, (hour + 1) * HOUR_US + wait) for wait in (DUE_US, CLOSED_US))
        out = []
        if emitted and new:
            out = [("retract", old_n, old_cents), ("replace", n, cents)]
        elif not emitted and due:
            emitted = True
            out = [("emit", n, cents)]
        elif not emitted and self.last:
            out = [("final", n, cents)]
        if out:
            yield pd.DataFrame([(self.batch, hour, "-1", rows, sum_, record, kind) for record, rows, sum_ in out], columns=["batch", "hour", "click_id", "n_rows", "cents", "record", "kind"])
        if not closed:
            state.update((n, cents, emitted))
            state.setTimeoutDuration(1)
        elif state.exists:
            state.remove()


def _reached(now: int | None, time: int) -> bool:
    return now is not None and now >= time


def pane_revisions(rows: DataFrame, batches: int = BATCHES, salts: int = SALTS) -> DataFrame:
    """(batch, hour, click_id, n_rows, cents, record, kind) of all batches, from (batch, click_id, event_us, kind, cents).

    Runs when it is called, one start of the query for each batch; the result reads the sink's table.
    """
    spark = rows.sparkSession
    folder = scratch_folder(spark, f"panes-{uuid.uuid4().hex}")
    marks = spark.range(batches).select(F.col("id").cast("int").alias("batch"), F.lit(True).alias("punctuation"))
    held = rows.withColumn("punctuation", F.lit(False)).unionByName(marks, allowMissingColumns=True)
    held.write.partitionBy("batch").parquet(f"{folder}/batches")
    greatest = spark.read.schema(f"{ROWS}, batch int").parquet(f"{folder}/batches").groupBy("batch").agg(F.max("event_us").alias("w")).collect()  # one row for each batch
    by_batch = {r.batch: r.w for r in greatest}

    session = spark.newSession()
    # a pane's state is three numbers; RocksDB would cost each store of each start its opening and native memory that Spark does not free
    session.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider")
    # every start has stores of its own, so none of an ended start may stay open beside the next one's
    session.conf.set("spark.sql.streaming.stateStore.unloadOnCommit", "true")
    if spark.sparkContext._jvm.java.net.URI(folder).getScheme() in (None, "file"):
        # on a local file system the default starts processes for each file that it renames
        session.conf.set("spark.sql.streaming.checkpointFileManagerClass", "org.apache.spark.sql.execution.streaming.checkpointing.FileSystemBasedCheckpointFileManager")
    session.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    session.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))  # a new session has the default
    for batch in range(batches):
        seen = [by_batch[b] for b in range(batch) if by_batch.get(b) is not None]
        move(spark, f"{folder}/batches/batch={batch}", f"{folder}/source/batch{batch}")
        _run_batch(session, folder, Merger(batch, max(seen, default=None), batch == batches - 1), salts)
    return spark.read.schema(RECORDS).parquet(f"{folder}/records")


def _run_batch(session: SparkSession, folder: str, merger: Merger, salts: int) -> None:
    """One start of the query over what is new in the source's folder."""
    hour = _floor_div(F.col("event_us"), HOUR_US)
    late = F.lit(False) if merger.now_us is None else F.lit(merger.now_us) >= (F.col("hour") + 1) * HOUR_US + CLOSED_US
    new = session.readStream.schema(ROWS).option("recursiveFileLookup", True).parquet(f"{folder}/source").filter("not punctuation")
    new = new.select(hour.alias("hour"), "kind", "click_id", "cents").withColumn("late", late)
    partial = new.mapInArrow(_partial_sums(salts), from_arrow_schema(PARTIAL))
    deltas = partial.repartition("hour", "kind", "salt").mapInArrow(_shards, from_arrow_schema(DELTA))
    records = deltas.groupBy("pane_hour", "pane_kind", "lane").applyInPandasWithState(merger, RECORDS.replace("click_id long", "click_id string"), TOTALS, "append", GroupStateTimeout.ProcessingTimeTimeout)
    records = records.withColumn("click_id", F.col("click_id").cast("long"))  # pandas would make floats of ids beside a null one
    query = records.writeStream.format("parquet").option("path", f"{folder}/records").option("checkpointLocation", f"{folder}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()


def click_panes(clicks: DataFrame, batches: int = BATCHES) -> DataFrame:
    """:func:`pane_revisions` of the clicks in their batches."""
    return pane_revisions(click_batches(clicks, batches), batches)


def click_panes_sql(batches: int = BATCHES) -> str:
    """The same rows in DuckDB's SQL, from all batches at once."""
    return f"""WITH raw AS (SELECT click_id, min(struct_pack(ts := epoch_us(ts::TIMESTAMP), arrived := epoch_us(arrived_at::TIMESTAMP), kind := kind, v := value)) AS r FROM clicks WHERE ts IS NOT NULL GROUP BY click_id),
 days AS (SELECT click_id, r.ts AS ts, floor(coalesce(r.arrived, r.ts) / {DAY_US}.0)::BIGINT AS d, coalesce(r.kind, 'none') AS kind, CASE WHEN r.v IS NULL OR NOT isfinite(r.v) THEN 0 ELSE floor(100 * r.v + 0.5)::BIGINT END AS cents FROM raw),
 cut AS (SELECT *, ((d % {batches}) + {batches}) % {batches} AS q FROM days),
 placed AS (SELECT click_id, kind, cents, ts - (d - q) * {DAY_US} AS event_us, least({batches - 1}, q + greatest(0, {crc32_sql("click_id")} % 30 - 23)) AS batch FROM cut),
 seen AS (SELECT b.batch, max(p.event_us) AS m FROM range({batches}) b(batch) LEFT JOIN placed p ON p.batch = b.batch GROUP BY 1),
 clock AS (SELECT batch, max(m) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS w FROM seen),
 dated AS (SELECT p.*, floor(event_us / {HOUR_US}.0)::BIGINT AS hour, w, coalesce(w >= (floor(event_us / {HOUR_US}.0)::BIGINT + 1) * {HOUR_US} + {CLOSED_US}, false) AS late FROM placed p JOIN clock c ON c.batch = p.batch),
 news AS (SELECT batch, hour, kind, count(*) AS n, sum(cents) AS c FROM dated WHERE NOT late GROUP BY ALL),
 panes AS (SELECT hour, kind, min(batch) AS first FROM news GROUP BY ALL),
 shown AS (SELECT hour, kind, min(c.batch) AS since FROM panes JOIN clock c ON c.batch >= first AND c.w >= (hour + 1) * {HOUR_US} + {DUE_US} GROUP BY ALL),
 sums AS (SELECT batch, hour, kind, sum(n) OVER w AS n, sum(c) OVER w AS c, n AS new_n, c AS new_c FROM news WINDOW w AS (PARTITION BY hour, kind ORDER BY batch)),
 firsts AS (SELECT coalesce(since, {batches - 1}) AS batch, p.hour, p.kind, CASE WHEN since IS NULL THEN 'final' ELSE 'emit' END AS record, sum(n.n) AS n, sum(n.c) AS c FROM panes p LEFT JOIN shown s ON s.hour = p.hour AND s.kind = p.kind JOIN news n ON n.hour = p.hour AND n.kind = p.kind AND n.batch <= coalesce(since, {batches - 1}) GROUP BY ALL),
 changes AS (SELECT s.batch, s.hour, s.kind, r.record, CASE WHEN r.record = 'retract' THEN s.n - new_n ELSE s.n END AS n, CASE WHEN r.record = 'retract' THEN s.c - new_c ELSE s.c END AS c FROM sums s JOIN shown e ON e.hour = s.hour AND e.kind = s.kind AND s.batch > e.since, (VALUES ('retract'), ('replace')) r(record))
SELECT batch::BIGINT AS batch, hour, click_id, 1::BIGINT AS n_rows, cents::BIGINT AS cents, 'late' AS record, kind FROM dated WHERE late
 UNION ALL SELECT batch::BIGINT, hour, -1, n::BIGINT, c::BIGINT, record, kind FROM firsts
 UNION ALL SELECT batch::BIGINT, hour, -1, n::BIGINT, c::BIGINT, record, kind FROM changes"""
