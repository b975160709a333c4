"""Exact top-k search by inner product: tiled matrix products, selection per tile, tree merging.

Queries and candidates are packed into blocks of bounded bytes, one row each, and dealt over the
rows and columns of a grid: each tile of candidates meets each block of queries in one place,
which an equi-join on the place finds. A task multiplies tile by block, keeps the k best of the
tile for each query, and merges them into its running lists; the tasks' lists are then merged
level by level. Neither queries nor candidates pass the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from .common import bounded_batches, checkpoint, shuffle_partitions

#: Bytes of a packed block or tile, rows of a product's two sides, and lists merged at once.
BLOCK_BYTES, BLOCK_ROWS, TILE_ROWS, FAN = 1 << 20, 2048, 2048, 64
#: Bytes of queries in a row of the grid, and of candidates in one of its places: so often is each candidate, and each query, copied.
GROUP_BYTES, PLACE_BYTES = 32 << 20, 256 << 20
_EXACT, _EXACT_SINGLE = float(1 << 53), float(1 << 24)
_LOWEST = np.iinfo(np.int64).min


def quantise(values: np.ndarray) -> np.ndarray:
    """floor(256 * x); what is too large for that becomes the largest double."""
    with np.errstate(over="ignore"):
        return np.nan_to_num(np.floor(256.0 * values.astype(np.float64)))


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products, in the shortest floats that are exact; in Python integers, held within 64 bits, where doubles aren't."""
    if not a.shape[1]:
        return np.zeros((len(a), len(b)), np.int64)
    largest = a.shape[1] * float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0))
    if largest < _EXACT_SINGLE:
        return a.astype(np.float32) @ b.astype(np.float32).T
    if largest < _EXACT:
        return a @ b.T
    whole = np.vectorize(int, otypes=[object])
    return np.clip(whole(a).dot(whole(b).T), -(1 << 63), (1 << 63) - 1).astype(np.int64)


def best(rows: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each row by score, ties to the smaller id; an id counts once a row, with its highest score."""
    # ~ turns the order of all 64-bit numbers; the least has no negative
    order = np.lexsort((~scores, ids, rows))
    rows, ids, scores = rows[order], ids[order], scores[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (ids[1:] != ids[:-1])
    rows, ids, scores = rows[new], ids[new], scores[new]
    order = np.lexsort((ids, ~scores, rows))
    rows, ids, scores = rows[order], ids[order], scores[order]
    place = np.arange(len(rows)) - np.searchsorted(rows, rows)
    return rows[place < k], ids[place < k], scores[place < k]


def tile_best(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, tile: np.ndarray, k: int, bar: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best candidates of one tile for each query; those below the query's bar, if there is one, may be left out."""
    order = np.argsort(ids, kind="stable")
    ids, tile = ids[order], tile[order]
    scores = _product(queries, tile)
    starts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
    if len(starts) < len(ids):
        scores, ids = np.maximum.reduceat(scores, starts, axis=1), ids[starts]
    own = np.minimum(np.searchsorted(ids, query_ids), len(ids) - 1)
    mine = np.flatnonzero(ids[own] == query_ids)
    whole = scores.dtype == np.int64
    scores[mine, own[mine]] = _LOWEST if whole else -np.inf
    if bar is not None:
        # the bar is a score of 64 bits; one that a shorter float can't hold is beyond all scores of this tile, and so is what it is rounded to
        good = scores >= (bar if whole else bar.astype(scores.dtype))[:, None]
    if bar is None or np.count_nonzero(good) > 4 * k * len(scores):
        place = np.partition(scores, -k, axis=1)[:, -k] if len(ids) > k else np.full(len(scores), _LOWEST if whole else -np.inf, scores.dtype)
        good = scores >= place[:, None]
    rows, cols = np.nonzero(good)
    others = ids[cols] != query_ids[rows]
    rows, cols = rows[others], cols[others]
    return best(rows, ids[cols], scores[rows, cols].astype(np.int64), k)


def _bar(rows: np.ndarray, scores: np.ndarray, n: int, k: int) -> np.ndarray:
    """The k-th score of each of n queries in their lists, rows by query and falling scores; the lowest where there are fewer."""
    ends = np.searchsorted(rows, np.arange(n), "right")
    full = ends - np.searchsorted(rows, np.arange(n)) >= k
    out = np.full(n, _LOWEST)
    out[full] = scores[ends[full] - 1]
    return out


def _by_length(ids: pa.Array, vectors: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    ids, offsets, flat = ids.to_numpy(zero_copy_only=False), vectors.offsets.to_numpy(), vectors.values.to_numpy(zero_copy_only=False)
    lengths = np.diff(offsets)
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        yield int(n), ids[at], flat[offsets[at][:, None] + np.arange(n)[None, :]]


_PACKED = "number long, n int, ids binary, vectors binary"


def _pack(block_bytes: int, kind: type):
    """Rows (id, vector) to blocks of vectors of one length, whose components are numbers of that kind."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for n, ids, vectors in _by_length(batch.column("id"), batch.column("vector")):
                step = max(1, block_bytes // (np.dtype(kind).itemsize * max(1, n)))
                for at in range(0, len(ids), step):
                    part = ids[at : at + step].astype(np.int64), np.ascontiguousarray(vectors[at : at + step], kind)
                    yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([n], pa.int32()), *[pa.array([x.tobytes()], pa.binary()) for x in part]], ["number", "n", "ids", "vectors"])
                    number += 1

    return pack


def _search(k: int, kind: type):
    """Pairs of a block of queries and a tile of candidates to the k best of each query, merged while the block stays the same."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty = (np.zeros(0, np.int64),) * 3
        part = TaskContext.get().partitionId()
        # lists of one block at a time for each task, as the join gives its rows by their place
        running, block = {}, None
        for batch in batches:
            for number, n, asked, queries, ids, vectors in zip(*(batch.column(c).to_pylist() for c in ("block", "n", "asked", "queries", "ids", "vectors")), strict=True):
                if number not in running and len(running) >= FAN:
                    yield from _lists(running, part)
                    running = {}
                if number != block:
                    block, query_ids, wanted = number, np.frombuffer(asked, np.int64), quantise(np.frombuffer(queries, kind).reshape(-1, n))
                found_ids, tile = np.frombuffer(ids, np.int64), quantise(np.frombuffer(vectors, kind).reshape(-1, n))
                own_ids, held = running.get(number, (query_ids, [empty] * -(-len(query_ids) // BLOCK_ROWS)))
                for i in range(len(held)):
                    q = slice(i * BLOCK_ROWS, (i + 1) * BLOCK_ROWS)
                    for c in range(0, len(found_ids), TILE_ROWS):
                        bar = _bar(held[i][0], held[i][2], len(query_ids[q]), k) if len(held[i][0]) else None
                        found = tile_best(query_ids[q], wanted[q], found_ids[c : c + TILE_ROWS], tile[c : c + TILE_ROWS], k, bar)
                        held[i] = best(*(np.concatenate(x) for x in zip(held[i], found, strict=True)), k)
                running[number] = own_ids, held
        yield from _lists(running, part)

    return search


def _lists(running: dict, part: int) -> Iterator[pa.RecordBatch]:
    for query_ids, held in running.values():
        for i, (rows, ids, scores) in enumerate(held):
            yield pa.RecordBatch.from_arrays([pa.array(query_ids[i * BLOCK_ROWS + rows]), pa.array(ids), pa.array(scores), pa.array(np.full(len(rows), part))], ["query_id", "vec_id", "score", "part"])


def exact_top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", block_bytes: int = BLOCK_BYTES, group_bytes: int = GROUP_BYTES, place_bytes: int = PLACE_BYTES) -> DataFrame:
    """For each query (a row that is_query holds for) its k best candidates: query_id, rank from 1, vec_id, score.

    Candidates are all rows with another id. Components become floor(256 * x); the score is their
    integer inner product, and ties go to the smaller id. Rows whose id or vector is null, or whose
    vector has null or non-finite components, take no part; vectors of another length than the
    query's aren't compared with it. Rows that repeat an id count once, with the highest score.
    Fewer candidates than k are all returned, none gives no row; an empty table gives none. Scores
    beyond 64 bits count as the largest or smallest number of 64 bits, and ties among those go to
    the smaller id.
    """
    # components keep their type, as double where it isn't float
    single = vectors.schema[vector_col].dataType.elementType == FloatType()
    value, kind = (F.col(vector_col), np.float32) if single else (F.col(vector_col).cast("array<double>"), np.float64)
    sound = F.col(id_col).isNotNull() & value.isNotNull() & ~F.exists(value, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    given = vectors.filter(sound)
    rows = given.select(F.col(id_col).cast("long").alias("id"), value.alias("vector"))
    asked = given.filter(is_query).select(F.col(id_col).cast("long").alias("id"), value.alias("vector")).distinct()
    bounded_batches(vectors.sparkSession)
    n_rows, n_asked, width = given.agg(F.count(F.lit(1)), F.count_if(is_query), F.max(F.size(value))).first()
    in_bytes = lambda n: n * np.dtype(kind).itemsize * max(1, width or 0)
    # the grid follows the data: rows by the bytes of queries, columns so that no place has too many candidates and all cores have
    # some, and no more than let the copies of the queries outweigh those of the candidates
    rows_of_grid = max(1, -(-in_bytes(n_asked) // group_bytes))
    spark = vectors.sparkSession
    places = min(shuffle_partitions(spark), max(2 * spark.sparkContext.defaultParallelism, rows_of_grid**2 * n_rows // max(1, n_asked)))
    columns = max(1, -(-places // rows_of_grid), -(-in_bytes(n_rows) // place_bytes))
    # queries are some of the rows, so they are brought together before they are packed
    n_blocks = max(1, -(-in_bytes(n_asked) // block_bytes))
    blocks = asked.repartition(n_blocks, F.xxhash64("id", "vector")).mapInArrow(_pack(block_bytes, kind), _PACKED)
    tiles = rows.mapInArrow(_pack(block_bytes, kind), _PACKED)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    blocks = blocks.select(F.pmod(F.xxhash64("number"), F.lit(rows_of_grid)).cast("int").alias("r"), every(columns).alias("c"), "n", F.col("number").alias("block"), F.col("ids").alias("asked"), F.col("vectors").alias("queries"))
    tiles = tiles.select(every(rows_of_grid).alias("r"), F.pmod(F.xxhash64("number"), F.lit(columns)).cast("int").alias("c"), "n", "ids", "vectors")
    # by its size before it is copied, a side may seem small enough to be broadcast, and its copies would all pass the driver
    pairs = blocks.join(tiles.hint("merge"), ["r", "c", "n"])
    lists = pairs.select("block", "n", "asked", "queries", "ids", "vectors").mapInArrow(_search(k, kind), "query_id long, vec_id long, score long, part long")
    lists = checkpoint(lists)
    parts = lists.rdd.getNumPartitions()
    while parts > FAN:
        lists, parts = _merge(lists.withColumn("part", F.floor(F.col("part") / FAN)), ["query_id", "part"], k).drop("rank"), -(-parts // FAN)
    return _merge(lists.drop("part"), ["query_id"], k).select("query_id", "rank", "vec_id", "score")


def _merge(lists: DataFrame, keys: list[str], k: int) -> DataFrame:
    once = lists.groupBy(*keys, "vec_id").agg(F.max("score").alias("score"))
    return once.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id"))).filter(F.col("rank") <= k)
