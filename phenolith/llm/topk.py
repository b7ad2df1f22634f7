"""Exact inner-product top-k over integer vectors with an impact-ordered index.

The index is built once and written: blocks of vectors, each with the postings of its components in
segments of one quantised impact (the bit length of their magnitude) and one dimension, highest
impact first. Queries meet each block as rows beside its index and are scored segment by segment;
after each impact, what is left of a vector can change its score by no more than the smaller of two
bounds. A query stops when few vectors can still reach its bar: its k-th best score of a first
block, or its k-th best lower bound here. These possible members are then scored exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import written

SCALE = 1024
BLOCK_ROWS = 8192
QUERY_ROWS = 256
#: Queries that one task takes through a block, at the first block and at all.
FIRST_QUERIES, PART_QUERIES = 2048, 65536
K = 10
#: A query is rescored when at most one in so many vectors of a block, or 2 * k, can be members.
FEW = 32
EXACT = 1 << 53


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, v: floor(scale * x) of each component; rows null or with a null or non-finite component go."""
    x = F.transform("embedding", lambda e: e.cast("double"))
    sound = F.forall("embedding", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    v = F.transform(x, lambda e: F.floor(e * F.lit(float(scale))).cast("long"))
    return vectors.where(F.col("embedding").isNotNull() & F.col("vec_id").isNotNull()).where(sound).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))


def _exact(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products, in floating point where every partial sum is an exact integer, else in integers."""
    if not queries.size or not vectors.size:
        return np.zeros((len(queries), len(vectors)), np.int64)
    most = float(np.abs(queries.astype(float)).max()) * float(np.abs(vectors.astype(float)).max()) * queries.shape[1]
    if most < EXACT:
        return np.rint(queries.astype(float) @ vectors.astype(float).T).astype(np.int64)
    if most < 1 << 62:
        return queries @ vectors.T
    total = queries.astype(object) @ vectors.astype(object).T
    return np.clip(total, -(1 << 63), (1 << 63) - 1).astype(np.int64)


class Postings(NamedTuple):
    """The posting segments of one block of vectors, highest impact first."""

    ids: np.ndarray  # of the vectors, in order
    impact: np.ndarray  # of each segment
    dim: np.ndarray
    start: np.ndarray  # of each segment among the postings, and their number
    at: np.ndarray  # vector of each posting
    value: np.ndarray


INDEX = "ids array<long>, impact array<int>, dim array<int>, start array<int>, at array<int>, value array<long>"


def postings(ids: np.ndarray, rows: list[np.ndarray]) -> Postings:
    order = np.argsort(ids, kind="stable")
    sizes = np.array([len(rows[k]) for k in order])
    at, dim = np.repeat(np.arange(len(order)), sizes), np.concatenate([np.arange(n) for n in sizes])
    value = np.concatenate([rows[k] for k in order]).astype(np.int64)
    some = np.flatnonzero(value)
    at, dim, value = at[some], dim[some], value[some]
    impact = np.ceil(np.log2(np.abs(value.astype(float)) + 1)).astype(np.int64)
    by = np.lexsort((at, dim, -impact))
    at, dim, value, impact = at[by], dim[by], value[by], impact[by]
    new = np.flatnonzero(np.append(True, (impact[1:] != impact[:-1]) | (dim[1:] != dim[:-1]))) if len(at) else np.zeros(0, np.int64)
    return Postings(ids[order], impact[new], dim[new], np.append(new, len(at)), at, value)


def search_block(index: Postings, query_ids: np.ndarray, queries: np.ndarray, bars: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, vec_id, score) of each query's k best among the vectors other than itself that may reach its bar (float)."""
    n, width = len(index.ids), max(queries.shape[1], int(index.dim.max(initial=-1)) + 1)
    queries = np.pad(queries, ((0, 0), (0, width - queries.shape[1])))
    dense = np.zeros((n, width), np.int64)
    dense[index.at, np.repeat(index.dim, np.diff(index.start))] = index.value
    squares = np.bincount(index.at, index.value.astype(float) ** 2, n)
    q = queries.astype(float)
    norm, sums = np.sqrt((q**2).sum(axis=1)), np.abs(q).sum(axis=1)
    active = np.arange(len(q))
    lower, rest = np.zeros((n, len(q))), squares.copy()
    members: dict[int, np.ndarray] = {}
    few = max(2 * k, n // FEW)
    value = index.value.astype(float)
    for begin, end in _impacts(index.impact):
        qa = np.ascontiguousarray(q[active].T)
        for s in range(begin, end):
            part = slice(index.start[s], index.start[s + 1])
            lower[index.at[part]] += value[part, None] * qa[index.dim[s]]
        part = slice(index.start[begin], index.start[end])
        rest = np.maximum(rest - np.bincount(index.at[part], value[part] ** 2, n), 0)
        cap = float(2 ** (int(index.impact[begin]) - 1) - 1)  # the largest magnitude of what follows
        error = 1 + 1e-12 * (np.sqrt(squares)[:, None] * norm[active] + np.where(np.isfinite(bars[active]), np.abs(bars[active]), 0))  # of floating point, at most
        slack = np.minimum(cap * sums[active], np.sqrt(rest)[:, None] * norm[active]) * (1 + 1e-9) + error
        own = index.ids[:, None] == query_ids[active]
        low = np.where(own, -np.inf, lower - slack)
        bar = np.maximum(bars[active], np.partition(low, -k, axis=0)[-k] if n >= k else -np.inf)
        possible = ~own & (lower + slack >= bar)
        done = possible.sum(axis=0) <= few  # proved: no other vector can be a member
        if done.any():
            members |= {int(active[j]): np.flatnonzero(possible[:, j]) for j in np.flatnonzero(done)}
            active, lower = active[~done], np.ascontiguousarray(lower[:, ~done])
        if not active.size:
            break
    out: list[list] = [[], [], []]
    for row in range(len(q)):
        at = members.get(row, np.flatnonzero(index.ids != query_ids[row]))
        scores = _exact(queries[row : row + 1], dense[at])[0]
        best = np.lexsort((index.ids[at], -scores.astype(object) if scores.size and scores.min() == -(1 << 63) else -scores))[:k]
        out[0] += [query_ids[row]] * len(best)
        out[1] += index.ids[at][best].tolist()
        out[2] += scores[best].tolist()
    return tuple(np.array(x, np.int64) for x in out)


def _impacts(impact: np.ndarray) -> Iterator[tuple[int, int]]:
    """The ranges of segments of one impact."""
    cuts = [0, *(np.flatnonzero(impact[1:] != impact[:-1]) + 1).tolist(), len(impact)] if len(impact) else [0]
    yield from zip(cuts[:-1], cuts[1:], strict=True)


def build_index(rows: DataFrame, n_blocks: int) -> DataFrame:
    """block and the postings of its vectors (vec_id, v), dealt to n_blocks by hash."""
    block = F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)).cast("long").alias("block")
    packed = rows.groupBy(block).agg(F.collect_list("vec_id").alias("ids"), F.collect_list("v").alias("vs"))  # about BLOCK_ROWS

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, vs = (batch.column(c)[i].values for c in (1, 2))
                index = postings(ids.to_numpy(), [v.values.to_numpy() if len(v) else np.zeros(0, np.int64) for v in vs])
                columns = [pa.array([x.tolist()], pa.list_(t)) for x, t in zip(index, [pa.int64(), *[pa.int32()] * 4, pa.int64()], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), *columns], names=["block", *Postings._fields])

    return packed.mapInArrow(build, "block long, " + INDEX)


def search(index: DataFrame, asked: DataFrame, k: int, parts: int) -> DataFrame:
    """query_id, vec_id, score: the k best of each block for asked (block, vec_id, v, bar).

    Index and queries of a block come as one sorted stream, so a block is read once for all queries of
    a part.
    """
    fields = Postings._fields
    none = F.lit(None)
    part = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("part")
    left = index.select("block", part, F.lit(0).alias("kind"), none.cast("long").alias("vec_id"), none.cast("array<long>").alias("v"), none.cast("double").alias("bar"), *fields)
    right = asked.select("block", F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("long").alias("part"), F.lit(1).alias("kind"), "vec_id", "v", "bar", *(none.cast(index.schema[f].dataType).alias(f) for f in fields))
    stream = left.unionByName(right).repartition("block", "part").sortWithinPartitions("block", "part", "kind")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, held_block = None, None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in (0, 1, 2)])
            blocks, kinds = keys[0], keys[2]
            cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if kinds[a] == 0:
                    held, held_block = Postings(*(batch.column(6 + c)[a].values.to_numpy() for c in range(len(fields)))), blocks[a]
                    continue
                if held_block != blocks[a]:  # a block without vectors
                    continue
                for c in range(a, b, QUERY_ROWS):
                    part = batch.slice(c, min(QUERY_ROWS, b - c))
                    vs = [np.array(v.as_py(), np.int64) for v in part.column(4)]
                    queries = np.zeros((len(vs), max(map(len, vs))), np.int64)
                    for i, v in enumerate(vs):
                        queries[i, : len(v)] = v
                    bars = part.column(5).fill_null(-np.inf).to_numpy()
                    found = search_block(held, part.column(3).to_numpy(), queries, bars, k)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["query_id", "vec_id", "score"])

    return stream.mapInArrow(scan, "query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, every: int = 100, k: int = K, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best of all other rows.

    Queries are the rows whose vec_id is divisible by ``every``. Vectors of different lengths
    count as padded with zeros; scores beyond 64 bits are clipped. Rows that repeat a vec_id are
    candidates each; a query repeated is answered once, by its first vector in order. No queries or
    no candidates give no rows.
    """
    rows = quantised(vectors, scale)
    n_blocks = max(1, -(-rows.count() // BLOCK_ROWS))
    index = written(build_index(rows, n_blocks), "topk-index")
    queries = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    n_queries = queries.count()
    # the first block's k-th best is a bar that no member can be below
    first = search(index.where("block = 0"), queries.select(F.lit(0).cast("long").alias("block"), "vec_id", "v", F.lit(None).cast("double").alias("bar")), k, max(1, -(-n_queries // FIRST_QUERIES)))
    bars = first.groupBy("query_id").agg(F.min("score").cast("double").alias("bar"), F.count("*").alias("n")).where(F.col("n") == k)
    known = queries.join(bars.select(F.col("query_id").alias("vec_id"), "bar"), "vec_id", "left")
    found = search(index, known.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))).alias("block"), "vec_id", "v", "bar"), k, max(1, -(-n_queries // PART_QUERIES)))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
