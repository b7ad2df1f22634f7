"""Near-duplicate documents by MinHash with tensored bands, every link confirmed on full sets.

Two collections of ``bands`` short bands each are computed from 2 * bands * rows minhashes. A
table key is a pair of one band of either collection, so bands**2 tables of 2 * rows hashes cost
about the square root of the minhashes that separate tables would need. A pair of sets at
similarity s is found if both collections have a band in common: at s = 0.85 with the defaults
all but about 2 in 100,000 are.

Within a bucket not all pairs are compared. Each bucket's members are compared with its pivot, the
member that shares most keys, and what is linked takes one label. Of the pairs that still share a
table key under different labels, an exact bound leaves few: two sets that are similar enough have
a shingle in common among the rarest of either, early enough for the rest to suffice, and shingles
held under one label alone count for nothing. Those pairs are compared on their full sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytescan import FOLDED, mix, span_hashes, text_batches, windows, word_bounds
from .storage import bitmap, in_bitmap, written

SHINGLE = 5
PERCENT = 85
BANDS = 12
ROWS = 3
NODE_BITS = 22
#: Members of a prefix bucket that one task compares with the others.
SALT_ROWS = 1000
MINHASH_BLOCK = 4096


def shingle_sets(data: np.ndarray, at: np.ndarray, n: int = SHINGLE) -> Iterator[np.ndarray]:
    """The sorted distinct n-word shingle hashes of each text; with fewer words, all of them as one."""
    starts, ends, rows = word_bounds(data, at)
    hashes = span_hashes(data, starts, ends, FOLDED)
    shingles, first = windows(hashes, rows, n)
    words_at = np.searchsorted(rows, np.arange(len(at)))
    shingles_at = np.searchsorted(rows[first], np.arange(len(at)))
    for k in range(len(at) - 1):
        a, b = words_at[k], words_at[k + 1]
        if 0 < b - a < n:
            x = np.array([b - a], np.uint64)
            for h in hashes[a:b]:
                x = mix(x ^ h) * np.uint64(3)
            yield x
        else:
            yield np.unique(shingles[shingles_at[k] : shingles_at[k + 1]])


def _seeds(count: int) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(7).integers(0, 1 << 63, (2, count), dtype=np.uint64)
    return draw[0], draw[1] * np.uint64(2) + np.uint64(1)


def _band_keys(shingles: np.ndarray, flip: np.ndarray, odd: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """2 * bands keys of the minhashes of one set."""
    least = np.full(len(flip), np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(shingles), MINHASH_BLOCK):
        np.minimum(least, ((shingles[k : k + MINHASH_BLOCK, None] ^ flip) * odd).min(axis=0), out=least)
    keys = np.arange(2 * bands, dtype=np.uint64)
    for column in least.reshape(2 * bands, rows).T:
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + column)
    return keys


def digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def signatures(docs: DataFrame, n: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, row: str | None = None) -> DataFrame:
    """doc_id, n_shingles, cls (a digest of the set), the band keys a and b, and ``row`` of every document."""
    flip, odd = _seeds(2 * bands * rows)
    more = [] if row is None else [row]

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, at in text_batches(batches):
            sizes, classes, a, b = [], [], [], []
            for s in shingle_sets(data, at, n):
                sizes.append(len(s))
                classes.append(digest(s))
                keys = _band_keys(s, flip, odd, bands, rows).view(np.int64) if len(s) else np.zeros(0, np.int64)
                a.append(keys[:bands])
                b.append(keys[bands:])
            long = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(classes, pa.binary()), pa.array(a, long), pa.array(b, long), *batch.columns[2:]],
                names=["doc_id", "n_shingles", "cls", "a", "b", *more],
            )

    kinds = "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in more)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *more).mapInArrow(
        sign, f"doc_id long, n_shingles long, cls binary, a array<long>, b array<long>{kinds}"
    )


def _shared(keys: DataFrame) -> DataFrame:
    """Rows whose key stands in two rows or more. Counted before joining, so a hot key stays spread."""
    return keys.join(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "key")


def buckets(classes: DataFrame) -> DataFrame:
    """key, node, size, degree: the tensored tables, without buckets of one member.

    A band that no other document has cannot be part of a shared pair; dropping those first
    leaves the pairs of few documents to form.
    """
    half = {c: _shared(classes.select("node", "size", F.explode(c).alias("key"))).select("node", "size", F.col("key").alias(c)) for c in "ab"}
    pairs = half["a"].join(half["b"].drop("size"), "node").select("node", "size", F.xxhash64("a", "b").alias("key"))
    members = written(_shared(pairs), "near-members")
    degree = members.groupBy("node").agg(F.sum("n").alias("degree"))
    return written(members.drop("n").join(degree, "node"), "near-buckets")


def sets_of(docs: DataFrame, nodes: DataFrame, n: int = SHINGLE) -> DataFrame:
    """node, shingles of nodes (node, cls, first): the set of each class, from its first document.

    A bounded bitmap of those documents spares shuffling the other texts.
    """
    wanted = docs.sparkSession.sparkContext.broadcast(bitmap(nodes.where("first is not null"), "first", NODE_BITS))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            held = in_bitmap(wanted.value, ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
            keep = batch.filter(pa.array(held | ids.is_null().to_numpy(zero_copy_only=False)))
            for part, data, at in text_batches(iter([keep])):
                found = list(shingle_sets(data, at, n))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([digest(s) for s in found], pa.binary()), pa.array([s.view(np.int64) for s in found], pa.list_(pa.int64()))],
                    names=["first", "cls", "shingles"],
                )

    some = docs.select(F.col("doc_id").cast("long").alias("first"), "text").mapInArrow(sets, "first long, cls binary, shingles array<long>")
    same = (some["cls"] == nodes["cls"]) & some["first"].eqNullSafe(nodes["first"])
    return some.join(nodes, same).select("node", "shingles").dropDuplicates(["node"])


def similar(inter: Column, a: Column, b: Column, percent: int) -> Column:
    """Whether sets of sizes a and b with ``inter`` in common are similar enough."""
    return inter * 100 >= (a + b - inter) * percent


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """x, y of the pairs that are linked, on their full sets."""
    both = pairs.join(sets.select(F.col("node").alias("x"), F.col("shingles").alias("sx")), "x").join(sets.select(F.col("node").alias("y"), F.col("shingles").alias("sy")), "y")
    inter = F.size(F.array_intersect("sx", "sy"))
    return both.where(similar(inter, F.size("sx"), F.size("sy"), percent)).select("x", "y")


def components(edges: DataFrame) -> DataFrame:
    """node, label: the smallest node reachable, for all nodes of edges (u, v).

    Alternating large-star and small-star rounds; minima are taken before joining back, so a node
    with very many links is no single group.
    """
    now = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    before = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = written(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "near-stars")
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("label"))
        before = state


def pivot_pairs(members: DataFrame) -> DataFrame:
    """x, y: every member of a bucket with the bucket's pivot."""
    best = F.max(F.struct("degree", "node")).alias("p")
    pivots = members.groupBy("key").agg(best).select("key", F.col("p.node").alias("pivot"))
    return members.join(pivots, "key").where("node <> pivot").select(F.least("node", "pivot").alias("x"), F.greatest("node", "pivot").alias("y")).distinct()


def prefix_pairs(members: DataFrame, labels: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """x, y: the pairs under different labels that may still be similar enough.

    Sets of sizes a and b need percent * (a + b) / (100 + percent) shingles in common. With the
    shingles of each in one order, rare ones first, their first common one has all others after it in
    both, so it stands among the first of either and leaves enough behind it. Only shingles held under
    two labels count, and a set's partners are no smaller than the least of its open buckets.
    """
    state = members.select("key", "node", "size").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    ends = state.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.min("size").alias("least")).where("low < high").select("key", "least")
    open_ = state.join(ends, "key").groupBy("node", "label", "size").agg(F.min("least").alias("least"))
    # a partner's size is at least percent / 100 of one's own
    least = F.greatest("least", F.ceil(F.col("size") * percent / 100))
    need = F.ceil((F.col("size") + least) * percent / (100 + percent)).cast("int")
    held = written(open_.withColumn("need", need).join(sets.select("node", F.explode("shingles").alias("s")), "node"), "near-held")
    counted = held.groupBy("s").agg(F.count("*").alias("c"), F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("s", "c")
    ranked = held.join(counted, "s").groupBy("node", "label", "size", "need").agg(F.array_sort(F.collect_list(F.struct("c", "s"))).alias("r")).where("size(r) >= need")
    prefix = ranked.select("node", "label", "size", F.size("r").alias("n"), F.posexplode(F.slice("r", F.lit(1), F.size("r") - F.col("need") + 1)).alias("at", "p"))
    prefix = written(prefix.select("node", "label", "size", (F.col("n") - F.col("at")).alias("after"), F.col("p.s").alias("s")), "near-prefix")
    hot = prefix.groupBy("s").agg(F.count("*").alias("f"), F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("s", F.ceil(F.col("f") / SALT_ROWS).alias("salts"))
    dealt = prefix.join(hot, "s")
    left = dealt.select("s", F.pmod(F.xxhash64("node"), F.col("salts")).alias("salt"), *(F.col(c).alias(f"{c}_x") for c in ("node", "label", "size", "after")))
    right = dealt.select("s", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), *(F.col(c).alias(f"{c}_y") for c in ("node", "label", "size", "after")))
    most = F.least("after_x", "after_y")
    near = (F.col("label_x") != F.col("label_y")) & (F.col("node_x") < F.col("node_y")) & similar(most, F.col("size_x"), F.col("size_y"), percent)
    return left.join(right, ["s", "salt"]).where(near).select(F.col("node_x").alias("x"), F.col("node_y").alias("y")).distinct()


def repeats(sig: DataFrame, classes: DataFrame) -> DataFrame:
    """u, v: classes of rows that repeat a doc_id, each with the first of them."""
    rows = sig.where("n_shingles > 0 and doc_id is not null").select("doc_id", "cls")
    twice = rows.groupBy("doc_id").agg(F.min("cls").alias("low"), F.max("cls").alias("high")).where("low < high").select("doc_id")
    held = rows.join(twice, "doc_id").distinct().join(classes.select("cls", F.col("node").alias("u")), "cls")
    return held.join(held.groupBy("doc_id").agg(F.min("u").alias("v")), "doc_id").where("u <> v").select("u", "v")


def links(members: DataFrame, sets: DataFrame, same: DataFrame, percent: int) -> DataFrame:
    """node, label of what the links of members, and the pairs of same (u, v), connect."""
    edge = lambda df: df.select(F.col("x").alias("u"), F.col("y").alias("v"))
    first = written(edge(confirmed(pivot_pairs(members), sets, percent)).unionByName(same), "near-links")
    labels = components(first)
    more = written(confirmed(prefix_pairs(members, labels, sets, percent), sets, percent), "near-more")
    if more.isEmpty():
        return labels
    return components(edge(more).unionByName(labels.select(F.col("node").alias("u"), F.col("label").alias("v"))))


def near_duplicates(docs: DataFrame, percent: int = PERCENT, n: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, row: str | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of docs.

    Documents with the same set form a class, which takes part once. component_id is the smallest doc_id
    of the component. Texts without words (null, empty) have the set size 0 and are their own component.
    Rows without a doc_id are linked by their sets like others; where a component has no doc_id at all,
    component_id is null. Rows that repeat a doc_id with different texts are compared each by its own set
    and stand for one document with the links of all. ``kept``: doc_id is component_id, null equal to null.
    With ``row``, a column that tells rows apart, that column and ``single`` are added: true for one row of
    each component and for all texts without words. An empty table gives an empty one; other columns are
    not carried.
    """
    sig = written(signatures(docs, n, bands, rows, row), "near-signatures")
    classes = sig.where("n_shingles > 0").groupBy("cls").agg(F.min("doc_id").alias("first"), F.min("n_shingles").alias("size"), F.first("a").alias("a"), F.first("b").alias("b"))
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()), "near-classes")
    members = buckets(classes)
    sets = written(sets_of(docs, classes.select("node", "cls", "first").join(members.select("node").distinct(), "node"), n), "near-sets")
    labels = written(classes.select("cls", "node", "first").join(links(members, sets, repeats(sig, classes), percent), "node", "left").withColumn("label", F.coalesce("label", "node")), "near-labels")
    smallest = labels.groupBy("label").agg(F.min("first").alias("component"))
    of_class = labels.join(smallest, "label").select("cls", "label", "component")
    out = sig.drop("a", "b").join(of_class, "cls", "left").withColumn("component_id", F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id")))
    kept = F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")
    if row is None:
        return out.select("doc_id", "n_shingles", "component_id", kept)
    out = written(out, "near-rows")
    one = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", row))[row]
    ones = out.where("label is not null").groupBy("label").agg(one.alias("one")).select(F.col("one").alias(row), F.lit(True).alias("one"))
    return out.join(ones, row, "left").select("doc_id", "n_shingles", "component_id", kept, row, (F.col("label").isNull() | F.col("one").isNotNull()).alias("single"))
