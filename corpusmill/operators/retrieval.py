"""Exact retrieval: neighbours, ranks of the truth, recall."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.vectors import dot

BLOCK = 4_096
STRIPE = 128  # queries of a tile that are compared at once


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 0))


def _tiles(queries: DataFrame, gallery: DataFrame, block: int) -> DataFrame:
    """(chunk, block, asks, id, v, own, truth): every query in a tile with every block of the gallery.

    Both sides are cut by hash into parts of about ``block`` rows; a tile holds one part of each.
    """
    blocks, chunks = (max(1, -(-df.count() // block)) for df in (gallery, queries))

    def part(n: int):
        return F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")

    asked = queries.select(part(chunks).alias("chunk"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(True).alias("asks"), "id", "v", "own", "truth")
    held = gallery.select(F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"), part(blocks).alias("block"), F.lit(False).alias("asks"), "id", "v")
    return asked.unionByName(held, allowMissingColumns=True).groupBy("chunk", "block")


def _sides(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Which rows ask, the asking ids and vectors, the held ids in order and their vectors."""
    asks, ids = table.column("asks").to_numpy(), table.column("id").to_numpy()
    v = _matrix(table.column("v").combine_chunks())
    order = np.argsort(ids[~asks], kind="stable")
    return asks, ids[asks], v[asks], ids[~asks][order], v[~asks][order]


def _stripes(asking: np.ndarray, held: np.ndarray, digits: int) -> Iterator[tuple[slice, np.ndarray]]:
    """The rounded similarities of some asking rows at a time: a whole tile of them would take hundreds of megabytes."""
    for start in range(0, len(asking), STRIPE):
        at = slice(start, start + STRIPE)
        yield at, np.round(asking[at] @ held.T, digits)


def vectors_of(df: DataFrame, id_col: str, vector: str) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(vector).alias("v")).filter("v is not null")


def best_of_tile(k: int, digits: int):
    """For each query of a tile the k held rows of largest inner product, ties by id, never itself."""

    def best(table: pa.Table) -> pa.Table:
        _, names, asking, held, v = _sides(table)
        out: list[tuple] = []
        for at, sims in _stripes(asking, v, digits):
            last = max(0, len(held) - k - 1)  # all that equal the last chosen one take part, for the ties
            least = np.partition(sims, last, axis=1)[:, last] if len(held) else np.zeros(len(sims))
            for name, row, bound in zip(names[at].tolist(), sims, least, strict=True):
                chosen = np.flatnonzero(row >= bound)
                chosen = chosen[np.argsort(-row[chosen], kind="stable")][: k + 1]
                out += [(name, int(held[c]), float(row[c])) for c in chosen.tolist() if held[c] != name][:k]
        columns = list(zip(*out, strict=True)) or [[], [], []]
        return pa.table({"query": pa.array(columns[0], pa.int64()), "neighbour": pa.array(columns[1], pa.int64()), "similarity": pa.array(columns[2], pa.float64())})

    return best


def merge_best(found: DataFrame, k: int) -> DataFrame:
    """(query, neighbour, similarity, place): the k best of what the tiles found for each query."""
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("similarity")).alias("s"), F.col("neighbour").alias("n"))))
    lists = found.groupBy("query").agg(F.slice(ordered, 1, k).alias("top"))
    return lists.select("query", F.posexplode("top").alias("p", "x")).select("query", F.col("x.n").alias("neighbour"), (-F.col("x.s")).alias("similarity"), (F.col("p") + 1).cast("long").alias("place"))


def topk(queries: DataFrame, gallery: DataFrame, k: int, id_col: str = "id", vector: str = "embedding", digits: int = 6, block: int = BLOCK) -> DataFrame:
    """(query, neighbour, similarity, place): the ``k`` gallery rows of largest inner product, ties by id; never itself.

    Tiles multiply matrices and keep k rows for each query; k rows from each tile are merged.  Memory follows the
    block, not the gallery.
    """
    asked = vectors_of(queries, id_col, vector).withColumns({"own": F.lit(None).cast("double"), "truth": F.lit(None).cast("long")})
    tiles = _tiles(asked, vectors_of(gallery, id_col, vector), block)
    return merge_best(tiles.applyInArrow(best_of_tile(k, digits), "query long, neighbour long, similarity double"), k)


def rank_of_truth(queries: DataFrame, gallery: DataFrame, truth: str, id_col: str = "id", vector: str = "embedding", digits: int = 6, block: int = BLOCK) -> DataFrame:
    """(query, rank): 1 and the number of gallery rows closer to the query than its true row; ties by id.

    ``queries`` has the id of its true gallery row in ``truth``; queries whose true row is missing are left out.  The
    similarity to the truth is joined first, then closer rows are counted tile by tile; nothing is sorted.
    """
    held = vectors_of(gallery, id_col, vector)
    asked = queries.select(F.col(id_col).cast("long").alias("id"), F.col(vector).alias("v"), F.col(truth).cast("long").alias("truth")).filter("v is not null")
    known = asked.join(held.select(F.col("id").alias("truth"), F.col("v").alias("tv")), "truth").select("id", "v", F.round(dot(F.col("v"), F.col("tv")), digits).alias("own"), "truth")

    def count(table: pa.Table) -> pa.Table:
        asks, names, asking, ids, v = _sides(table)
        own, true = (table.column(c).filter(pa.array(asks)).to_numpy()[:, None] for c in ("own", "truth"))
        closer = np.zeros(len(names), np.int64)
        for at, sims in _stripes(asking, v, digits):
            closer[at] = ((sims > own[at]) | ((sims == own[at]) & (ids[None, :] < true[at]))).sum(axis=1)
        return pa.table({"query": pa.array(names, pa.int64()), "closer": pa.array(closer, pa.int64())})

    return _tiles(known, held, block).applyInArrow(count, "query long, closer long").groupBy("query").agg((1 + F.sum("closer")).alias("rank"))


def recall_at(ranks: DataFrame, ks: tuple[int, ...] = (1, 5, 10), rank: str = "rank") -> DataFrame:
    """(k, recall, n) for each k; no rows of ranks give no recall."""
    spread = ranks.select(rank, F.explode(F.array(*(F.lit(k) for k in ks))).alias("k"))
    return spread.groupBy("k").agg(F.avg((F.col(rank) <= F.col("k")).cast("double")).alias("recall"), F.count(F.lit(1)).alias("n"))


def first_segment(matches: DataFrame, segs: DataFrame, figure: str = "figure_id", text: str = "text") -> DataFrame:
    """``matches`` with ``seg_idx``: the first segment of the figure whose text equals the matched text."""
    first = segs.groupBy(figure, text).agg(F.min("seg_idx").alias("seg_idx"))
    return matches.join(first, [figure, text], "left")

