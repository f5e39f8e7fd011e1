"""Approximate neighbours by an inverted file: cells around centroids, probes as an equi-join, exact ranks inside.

Centroids are fitted on a bounded sample, by rounds in which every partition sums its vectors by nearest centroid.
Every gallery row goes to the cell of its nearest centroid, every query to the cells of its nearest few, and queries meet
the rows of their cells in tiles of bounded size, which multiply matrices.  What is found is ranked exactly; only rows of
cells that were not probed can be missed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.operators.retrieval import BLOCK, best_of_tile, merge_best, topk, vectors_of
from corpusmill.plans.scratch import materialize

SAMPLE = 20_000  # vectors that the centroids are fitted on at most
MAX_CELLS = 4_096
ROUNDS = 8
PARTS = 8
CHUNK = 128  # vectors that are compared with all centroids at once
COPIES = 8_192  # rows that a task makes at once, one for each vector and probe
CELLS_A_ROOT = 8  # cells for each unit of the root of the number of rows
TUNING = 200  # queries that the number of probes is chosen by at most


@dataclass
class Index:
    """Centroids of unit length, one for each cell, and the gallery as (cell, id, v)."""

    centroids: np.ndarray
    rows: DataFrame

    def sizes(self) -> DataFrame:
        """(cell, n) of the cells that hold rows; no more rows than there are centroids."""
        return self.rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=-1, keepdims=True), 1e-300)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), np.float64).reshape(len(column), -1)


def _nearest(v: np.ndarray, centroids: np.ndarray, probes: int) -> np.ndarray:
    """The places of the ``probes`` nearest centroids by inner product, ties to the first."""
    near = np.round(_unit(v) @ centroids.T, 9)
    return near.argmax(1)[:, None] if probes == 1 else np.argsort(-near, axis=1, kind="stable")[:, :probes]


def _cell_sums(centroids: np.ndarray):
    """Every partition's vectors summed by nearest centroid, and their numbers, as bytes of one matrix."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(centroids), centroids.shape[1] + 1))
        for batch in batches:
            for start in range(0, batch.num_rows, CHUNK):
                v = _unit(_matrix(batch.column(0).slice(start, CHUNK)))
                np.add.at(sums, _nearest(v, centroids, 1)[:, 0], np.hstack([v, np.ones((len(v), 1))]))
        yield pa.RecordBatch.from_arrays([pa.array([sums.tobytes()], pa.binary())], names=["sums"])

    return rows


def _assigned(df: DataFrame, centroids: np.ndarray, probes: int) -> DataFrame:
    """(cell, id, v): each row once for each of its nearest ``probes`` cells."""

    step = max(1, min(CHUNK, COPIES // max(1, probes)))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                cells = _nearest(_matrix(part.column(1)), centroids, probes)
                at = pa.array(np.repeat(np.arange(part.num_rows), cells.shape[1]))
                yield pa.RecordBatch.from_arrays([pa.array(cells.ravel(), pa.int64()), part.column(0).take(at), part.column(1).take(at)], names=["cell", "id", "v"])

    return df.select("id", "v").mapInArrow(rows, f"cell long, id long, v {dict(df.dtypes)['v']}")


def fit_centroids(vectors: DataFrame, cells: int, sample: int = SAMPLE, rounds: int = ROUNDS) -> np.ndarray:
    """Spherical k-means of at most ``sample`` rows of (id, v), those with the smallest hashes of their ids.

    The first of them are the first centroids; a centroid without rows stays.  Each round brings a fixed number of
    matrices of the centroids' size to the driver, and no row.
    """
    drawn = vectors.orderBy(F.xxhash64("id"), "id").limit(sample)
    drawn = materialize(drawn.repartition(PARTS, "id"), "centroid-sample")
    first = drawn.orderBy(F.xxhash64("id"), "id").select("v").limit(cells).collect()
    if not first:
        return np.empty((0, 0))
    centroids = _unit(np.array([r.v for r in first], np.float64))
    for _ in range(rounds):
        parts = drawn.select("v").mapInArrow(_cell_sums(centroids), "sums binary").collect()
        sums = sum(np.frombuffer(b).reshape(len(centroids), -1) for b in sorted(bytes(r["sums"]) for r in parts))
        held = sums[:, -1] > 0
        centroids[held] = _unit(sums[held, :-1])
    return centroids


def build_index(gallery: DataFrame, id_col: str = "id", vector: str = "embedding", cells: int | None = None, sample: int = SAMPLE) -> Index:
    """An index over all rows of ``gallery`` that have a vector, written to the scratch folder.

    ``cells`` is CELLS_A_ROOT times the root of the number of rows unless given, and at most MAX_CELLS, which bounds
    what goes to the tasks.  Vectors must have one length.
    """
    held = vectors_of(gallery, id_col, vector)
    if cells is None:
        cells = min(MAX_CELLS, max(1, round(CELLS_A_ROOT * held.count() ** 0.5)))
    centroids = fit_centroids(held, cells, sample)
    if not len(centroids):
        return Index(centroids, materialize(held.select(F.lit(0).cast("long").alias("cell"), "id", "v"), "index"))
    return Index(centroids, materialize(_assigned(held, centroids, 1), "index"))


def probes_for(index: Index, queries: DataFrame, gallery: DataFrame, k: int, target: float, id_col: str = "id", vector: str = "embedding", tuning: int = TUNING) -> int:
    """The least number of probes that finds a share of ``target`` of the true ``k`` neighbours of a sample of queries.

    The sample is at most ``tuning`` queries, by hash; its neighbours are found exactly, and each counts by the place of
    its cell among those nearest to the query.
    """
    asked = vectors_of(queries, id_col, vector).orderBy(F.xxhash64(F.lit("tuning"), "id"), "id").limit(tuning)
    asked = materialize(asked, "tuning")
    truth = topk(asked, gallery.select(F.col(id_col).alias("id"), F.col(vector).alias("v")), k, vector="v")
    where = truth.join(index.rows.select(F.col("id").alias("neighbour"), "cell"), "neighbour").join(asked.select(F.col("id").alias("query"), "v"), "query")

    centroids = index.centroids

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, CHUNK):
                part = batch.slice(start, CHUNK)
                order = _nearest(_matrix(part.column(1)), centroids, len(centroids))
                yield pa.RecordBatch.from_arrays([pa.array((order == part.column(0).to_numpy()[:, None]).argmax(1) + 1, pa.int64())], names=["place"])

    # no more rows than there are cells
    counts = where.select("cell", "v").mapInArrow(place, "place long").groupBy("place").agg(F.count(F.lit(1)).alias("n")).orderBy("place").collect()
    found, total = 0, sum(r.n for r in counts)
    for r in counts:
        found += r.n
        if found >= target * total:
            return r.place
    return max(1, len(index.centroids))


def compared_pairs(index: Index, queries: DataFrame, probes: int, id_col: str = "id", vector: str = "embedding") -> DataFrame:
    """(compared, all_pairs): pairs of a query and a gallery row that a search compares, and that there are."""
    asked = _assigned(vectors_of(queries, id_col, vector), index.centroids, probes).groupBy("cell").agg(F.count(F.lit(1)).alias("asks"))
    met = asked.join(index.sizes(), "cell").agg(F.coalesce(F.sum(F.col("asks") * F.col("n")), F.lit(0)).alias("compared"))
    total = vectors_of(queries, id_col, vector).agg(F.count(F.lit(1)).alias("q")).crossJoin(index.rows.agg(F.count(F.lit(1)).alias("g")))  # one row each
    return met.crossJoin(total).select("compared", (F.col("q") * F.col("g")).alias("all_pairs"))


def search(index: Index, queries: DataFrame, k: int, probes: int, id_col: str = "id", vector: str = "embedding", digits: int = 6, block: int = BLOCK) -> DataFrame:
    """(query, neighbour, similarity, place): of the rows in each query's nearest ``probes`` cells the ``k`` best by inner product, ties by id; never itself.

    A cell of any size is cut into blocks by hash, and so are the queries that probe it, so no task holds a whole hot
    cell.  A query whose probed cells hold fewer than k others gets fewer rows.
    """
    if not len(index.centroids):
        return queries.sparkSession.createDataFrame([], "query long, neighbour long, similarity double, place long")
    asked = materialize(_assigned(vectors_of(queries, id_col, vector), index.centroids, probes), "probes")
    # one row for each cell
    parts = index.sizes().select("cell", F.ceil(F.col("n") / block).alias("blocks")).join(asked.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / block).alias("chunks")), "cell")
    parts = F.broadcast(materialize(parts, "cells"))

    def part(n: str):
        return F.pmod(F.xxhash64("id"), F.col(n))

    def each(n: str):
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))

    asks = asked.join(parts, "cell").withColumn("block", each("blocks")).select("cell", part("chunks").alias("chunk"), "block", F.lit(True).alias("asks"), "id", "v")
    held = index.rows.join(parts, "cell").withColumn("chunk", each("chunks")).select("cell", "chunk", part("blocks").alias("block"), F.lit(False).alias("asks"), "id", "v")
    tiles = asks.unionByName(held).groupBy("cell", "chunk", "block")
    return merge_best(tiles.applyInArrow(best_of_tile(k, digits), "query long, neighbour long, similarity double"), k)
