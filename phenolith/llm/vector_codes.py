"""Compression of vectors to short codes: one small codebook for each of their parts, fitted by Lloyd rounds over two trees.

Rows are dealt once into blocks, each written with its parts in the order of a tree that halves them at
their widest position. A round walks that tree and a tree of the codebook's entries together: distances
between the boxes of two nodes prune pairs that cannot be nearest, a node left with one entry goes to it
whole with its cached sum, and what stays uncertain at the leaves is settled by exact integer distances.
Only sums by part and entry leave the tasks; a codebook is the one thing sent to them, of a size fixed by
the number of entries and the length of the vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import written

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
BLOCK = 4096
LEAF = 32
#: Components beyond this, after scaling, would not leave sums and squared distances in 64 bits.
LARGEST = 1 << 28
SALTS = 16


def edges(n: int, level: int) -> np.ndarray:
    """Where the nodes of a level begin in a tree over n places, and n: halves of halves."""
    return (np.arange((1 << level) + 1, dtype=np.int64) * n) >> level


def depth_of(n: int, leaf: int = LEAF) -> int:
    """Levels until no node holds more than ``leaf`` places."""
    return max(0, (max(n, 1) - 1) // leaf).bit_length()


def tree_order(x: np.ndarray, depth: int) -> np.ndarray:
    """Order of the rows of x in which every node is a run of rows, split where its widest position halves it."""
    order = np.arange(len(x))
    for level in range(depth):
        at = edges(len(x), level)
        middle = edges(len(x), level + 1)[1::2]
        for lo, mid, hi in zip(at[:-1], middle, at[1:], strict=True):
            if lo < mid < hi:
                own = x[order[lo:hi]]
                widest = int(np.argmax(own.max(0) - own.min(0)))
                order[lo:hi] = order[lo:hi][np.argpartition(own[:, widest], mid - lo)]
    return order


def boxes(x: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest component at every position of each node of a level; x is in tree order."""
    at = edges(len(x), level)[:-1]
    return np.minimum.reduceat(x, at, axis=0), np.maximum.reduceat(x, at, axis=0)


def bounds(lo: np.ndarray, hi: np.ndarray, entry_lo: np.ndarray, entry_hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest squared distance between the boxes of each pair of nodes, in integers."""
    gap = np.maximum(np.maximum(entry_lo - hi, lo - entry_hi), 0)
    span = np.maximum(entry_hi - lo, hi - entry_lo)
    return (gap * gap).sum(1), (span * span).sum(1)


def distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of x to all entries, in integers.

    Where every product and sum stays below 2**53 they are formed in doubles, which hold such integers exactly.
    """
    top = max(int(np.abs(x).max(initial=0)), int(np.abs(entries).max(initial=0)), 1)
    kind = np.float64 if 4 * top * top * max(x.shape[1], 1) < 1 << 53 else np.int64
    a, b = x.astype(kind), entries.astype(kind)
    return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None, :]).astype(np.int64)


class Assignment:
    """Nearest entry of every row of one block and part, by the two trees.

    ``whole`` lists the (level, node, entry) that went as one; ``entry`` and ``error`` are by row, in tree order.
    """

    def __init__(self, x: np.ndarray, entries: np.ndarray, exact_errors: bool = True) -> None:
        self.x, self.whole = x, []
        self.entry = np.full(len(x), -1, np.int64)
        rank = tree_order(entries, deep := depth_of(len(entries), 1))
        ordered = entries[rank]
        # below deep, where a node may be empty, entries stand alone
        n, low, level_e = len(entries), depth_of(len(x)), 0
        pairs_p, pairs_e = np.zeros(1, np.int64), np.zeros(1, np.int64)
        lone = n == 1
        level = 0
        while len(x):
            at_p = edges(len(x), level)
            lo, hi = boxes(x, level)
            if lone:
                e_lo = e_hi = ordered
            else:
                e_lo, e_hi = boxes(ordered, level_e)
            least, most = bounds(lo[pairs_p], hi[pairs_p], e_lo[pairs_e], e_hi[pairs_e])
            best = np.full(len(at_p) - 1, np.iinfo(np.int64).max)
            np.minimum.at(best, pairs_p, most)
            keep = least <= best[pairs_p]
            pairs_p, pairs_e = pairs_p[keep], pairs_e[keep]
            if lone:
                left = np.bincount(pairs_p, minlength=len(at_p) - 1)
                sure = left[pairs_p] == 1
                for p, e in zip(pairs_p[sure], pairs_e[sure], strict=True):
                    self.whole.append((level, int(p), int(rank[e])))
                    self.entry[at_p[p] : at_p[p + 1]] = rank[e]
                pairs_p, pairs_e = pairs_p[~sure], pairs_e[~sure]
            if not pairs_p.size or (level == low and lone):
                break
            if not lone:
                level_e += 1
                if level_e == deep:  # one entry at most in each node
                    lone = True
                    first, last = edges(n, deep - 1)[pairs_e], edges(n, deep - 1)[pairs_e + 1]
                    pairs_p, pairs_e = np.repeat(pairs_p, last - first), np.concatenate([np.arange(a, b) for a, b in zip(first, last, strict=True)])
                else:
                    pairs_p, pairs_e = np.repeat(pairs_p, 2), (2 * pairs_e[:, None] + np.arange(2)).ravel()
            if level < low:
                level += 1
                pairs_p, pairs_e = (2 * pairs_p[:, None] + np.arange(2)).ravel(), np.repeat(pairs_e, 2)
                order = np.argsort(pairs_p, kind="stable")
                pairs_p, pairs_e = pairs_p[order], pairs_e[order]
        if pairs_p.size:
            at_p = edges(len(x), level)
            cuts = np.flatnonzero(np.r_[True, pairs_p[1:] != pairs_p[:-1], True])
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                rows = slice(at_p[pairs_p[a]], at_p[pairs_p[a] + 1])
                near = np.sort(rank[pairs_e[a:b]])  # the first of equal distances has the lowest index
                self.entry[rows] = near[np.argmin(distances(x[rows], entries[near]), axis=1)]
        if exact_errors:
            off = x - entries[self.entry]
            self.error = (off * off).sum(1)

    def sums(self, n_entries: int) -> tuple[np.ndarray, np.ndarray]:
        """Count and sum of the rows of each entry: whole nodes by their cached sums, the rest by row."""
        x = self.x
        count, total = np.zeros(n_entries, np.int64), np.zeros((n_entries, x.shape[1]), np.int64)
        rest = np.ones(len(x), bool)
        prefix: np.ndarray | None = None
        for level, node, entry in self.whole:
            if prefix is None:  # sums of nodes are differences of running sums
                prefix = np.vstack([np.zeros((1, x.shape[1]), np.int64), np.cumsum(x, axis=0)])
            lo, hi = int(len(x) * node >> level), int(len(x) * (node + 1) >> level)
            count[entry] += hi - lo
            total[entry] += prefix[hi] - prefix[lo]
            rest[lo:hi] = False
        own = self.entry[rest]
        count += np.bincount(own, minlength=n_entries)
        np.add.at(total, own, x[rest])
        return count, total


def scaled(rows: list[list[float]]) -> np.ndarray:
    """floor(SCALE * component) of every component, as integers."""
    wide = {len(r) for r in rows}
    if len(wide) > 1:
        raise ValueError(f"vectors of different lengths: {sorted(wide)[:5]}")
    x = np.floor(SCALE * np.asarray(rows, np.float64).reshape(len(rows), -1))
    if np.abs(x).max(initial=0) > LARGEST:
        raise ValueError(f"a component beyond {LARGEST / SCALE}")
    return x.astype(np.int64)


def usable(vectors: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector is not null and holds only finite components."""
    x = F.col(vector)
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return vectors.where(x.isNotNull() & fine)


def blocks(vectors: DataFrame, vector: str, parts: int, block: int) -> DataFrame:
    """id, label, dim and, for each part, ``x`` and ``order`` of up to ``block`` vectors a row, in tree order."""

    def built(ids: list, labels: list, rows: list) -> dict:
        x = scaled(rows)
        if x.shape[1] % parts:
            raise ValueError(f"vectors of length {x.shape[1]} have no {parts} equal parts")
        width, made = x.shape[1] // parts, {"ids": ids, "labels": labels, "dim": x.shape[1], "parts": []}
        for k in range(parts):
            own = x[:, k * width : (k + 1) * width]
            order = tree_order(own, depth_of(len(own)) if width else 0)
            made["parts"].append({"order": order.astype(np.int32).tobytes(), "x": own[order].tobytes()})
        return made

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        labels: list = []
        rows: list = []
        for batch in batches:
            for i, label, row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids.append(i)
                labels.append(label)
                rows.append(row)
                if len(rows) == max(LEAF, min(block, (1 << 22) // max(len(row), 1))):
                    yield pa.RecordBatch.from_pylist([built(ids, labels, rows)], schema=form)
                    ids, labels, rows = [], [], []
        if rows:
            yield pa.RecordBatch.from_pylist([built(ids, labels, rows)], schema=form)

    label_type = vectors.schema["label"].dataType
    out = T.StructType(
        [
            T.StructField("ids", T.ArrayType(T.LongType())),
            T.StructField("labels", T.ArrayType(label_type)),
            T.StructField("dim", T.IntegerType()),
            T.StructField("parts", T.ArrayType(T.StructType([T.StructField("order", T.BinaryType()), T.StructField("x", T.BinaryType())]))),
        ]
    )
    from pyspark.sql.pandas.types import to_arrow_schema

    form = to_arrow_schema(out)
    return vectors.select(F.col("vec_id").cast("long"), "label", vector).mapInArrow(deal, out)


def part_of(part: dict, width: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.frombuffer(part["order"], np.int32)
    return order, np.frombuffer(part["x"], np.int64).reshape(len(order), width)


def lloyd_round(dealt: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """The codebooks after one assignment of all parts and the mean, rounded down, of each entry's parts."""
    width = books[0].shape[1]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for parts in batch.column(0).to_pylist():
                for k, (part, book) in enumerate(zip(parts, books, strict=True)):
                    count, total = Assignment(part_of(part, width)[1], book, exact_errors=False).sums(len(book))
                    used = np.flatnonzero(count)
                    columns = [np.full(len(used), k, np.int32), used.astype(np.int32), count[used], *total[used].T]
                    yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names=names)

    names = ["part", "entry", "n", *(f"s{i}" for i in range(width))]
    types = ["part int", "entry int", "n long", *(f"s{i} long" for i in range(width))]
    sums = dealt.select("parts").mapInArrow(assign, ", ".join(types)).groupBy("part", "entry").agg(*(F.sum(c).alias(c) for c in names[2:]))
    out = [b.copy() for b in books]
    for row in sums.collect():  # one row for each entry of a codebook at most
        out[row["part"]][row["entry"]] = [row[f"s{i}"] // row["n"] for i in range(width)]
    return out


def vector_codes(
    vectors: DataFrame, vector: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, block: int = BLOCK
) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every vector.

    Vectors that are null or hold null, NaN or infinite components are left out. Components become
    floor(1024 * x), vectors ``parts`` equal consecutive parts. Each part's codebook starts as that part of
    the ``entries`` smallest vec_ids (null last, rows that repeat one in order of their components); with
    fewer rows it has so many entries. ``rounds`` times all parts go to their nearest entry, ties to
    the lower index, and used entries become the mean of their parts, rounded down. ``code`` has two hex digits (more if
    ``entries`` needs them) for each part, ``error`` is the squared distance left, ``label_error`` its sum over
    rows of the same label, null being one, and codebooks_sha256 the digest of all entries. Rows that
    repeat a vec_id are vectors each. Without usable rows the result is empty. Lengths that differ or have no
    equal parts, and components beyond 2**18, are errors. Other columns are not carried.
    """
    kept = usable(vectors.select("vec_id", "label", vector), vector)
    dealt = written(blocks(kept, vector, parts, block), "vector-blocks")
    by_id = F.col("vec_id").cast("long").asc_nulls_last()
    first = scaled([r[0] for r in kept.orderBy(by_id, F.col(vector)).select(vector).limit(entries).collect()] or [[]])
    seen = [r[0] for r in dealt.select("dim").distinct().limit(2).collect()]
    if len(seen) > 1:
        raise ValueError(f"vectors of different lengths: {sorted(seen)}")
    width = first.shape[1] // parts
    books = [np.ascontiguousarray(first[:, k * width : (k + 1) * width]) for k in range(parts)]
    for _ in range(rounds if seen and width else 0):
        books = lloyd_round(dealt, books)
    digest = hashlib.sha256(",".join(str(c) for b in books for c in b.ravel()).encode()).hexdigest()
    digits = max(2, len(f"{max(entries - 1, 0):x}"))

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, labels, own in zip(batch.column(0), batch.column(1), batch.column(2).to_pylist(), strict=True):
                n = len(ids)
                error, code = np.zeros(n, np.int64), np.zeros((n, parts), np.int64)
                for k, (part, book) in enumerate(zip(own, books, strict=True)):
                    order, x = part_of(part, width)
                    found = Assignment(x, book)
                    code[order, k] = found.entry
                    error[order] += found.error
                text = ["".join(f"{c:0{digits}x}" for c in row) for row in code.tolist()]
                yield pa.RecordBatch.from_arrays([ids.values, labels.values, pa.array(text, pa.string()), pa.array(error)], names=["vec_id", "label", "code", "error"])

    label_type = vectors.schema["label"].dataType.simpleString()
    out = written(dealt.select("ids", "labels", "parts").mapInArrow(coded, f"vec_id long, label {label_type}, code string, error long"), "vector-codes")
    # a label may have a third of all rows: its sum is sent to as many places as rows are dealt to
    sums = out.groupBy("label").agg(F.sum("error").alias("label_error")).withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows, sums = out.withColumn("__salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int")).alias("r"), sums.alias("s")
    joined = rows.join(sums, F.col("r.label").eqNullSafe(F.col("s.label")) & (F.col("r.__salt") == F.col("s.__salt")))
    return joined.select("r.vec_id", "r.code", "r.error", "s.label_error", F.lit(digest).alias("codebooks_sha256"))
