"""Merkle manifest of a table: every row a leaf, a tree for each source, and a tree of the sources' roots.

Nodes are written only every ``stride`` levels. A proof goes down those stored levels: a task holds one
aligned subtree of ``run ** stride`` stored nodes at most, makes the levels between again from them, emits each
node's siblings up to the subtree's top, adds the siblings above, which are the same for the whole subtree, and
keeps nothing. So a source of any size is many subtrees, no task and no row of state grows with it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import written

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
RUN = 16
STRIDE = 3
#: Rows of the table of first places that may be sent to every task; it has one for each source and task.
PLACES = 20_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(*values: str) -> str:
    """sha256 of the values, concatenated, as lowercase hex."""
    return hashlib.sha256("".join(values).encode()).hexdigest()


def leaf(*values: Column) -> Column:
    """Digest of values, each as its length in bytes, a colon and itself, or as - if it is null."""
    one = lambda v: F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-"))
    return F.sha2(F.concat(*(one(v.cast("string")) for v in values)), 256)


def tampered(doc_id: Column, text: Column) -> tuple[Column, Column]:
    """Whether a row is one of those to test tampering on, and its text then: A to Z in lower case."""
    return F.coalesce(F.crc32(doc_id.cast("long").cast("string").cast("binary")) % 5 == 0, F.lit(False)), F.translate(text, UPPER, LOWER)


def placed(nodes: DataFrame, *order: str) -> DataFrame:
    """nodes with ``pos``, each one's place in its group ``g`` in that order (null first), and ``n``, the group's size.

    Ranges of (g, order) are sorted each in a task, so one group may spread over all of them; places
    are counts of the ranges before and of the rows before in the range.
    """
    keys = [F.col(c).asc_nulls_first() for c in ("g", *order)]
    sorted_ = nodes.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id())
    sorted_ = written(sorted_.withColumn("range", F.shiftright("at", 33)), "merkle-sorted")
    before = Window.partitionBy("g").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    first = sorted_.groupBy("g", "range").agg(F.min("at").alias("first"), F.count("*").alias("rows"))
    # one row of a group for each range
    first = first.select("g", "range", "first", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("before"), F.sum("rows").over(Window.partitionBy("g")).alias("n"))
    first = written(first, "merkle-places")
    small = F.broadcast(first) if first.limit(PLACES + 1).count() <= PLACES else first
    r, f = sorted_.alias("r"), small.alias("f")
    joined = r.join(f, F.col("r.g").eqNullSafe(F.col("f.g")) & (F.col("r.range") == F.col("f.range")))
    return joined.select("r.*", (F.col("at") - F.col("first") + F.col("before")).alias("pos"), "n").drop("at", "range")


def levels_of(n: int, run: int, most: int) -> int:
    """Levels above n nodes until one is left, at most ``most``."""
    k = 0
    while n > 1 and k < most:
        n, k = -(-n // run), k + 1
    return k


def subtree(nodes: list[str], levels: int, run: int) -> list[list[str]]:
    """The nodes and the levels above them, made from them."""
    made = [nodes]
    for _ in range(levels):
        below = made[-1]
        made.append([digest(*below[i : i + run]) for i in range(0, len(below), run)])
    return made


def by_subtree(rows: DataFrame, work: Callable[[list[dict]], Iterator[dict]], out: str) -> DataFrame:
    """``work`` on the rows of each (g, sub), in order of pos, null first; ranges of subtrees are dealt to tasks."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        made: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if held and (row["g"], row["sub"]) != (held[0]["g"], held[0]["sub"]):
                    made += work(held)
                    held = []
                    if len(made) >= 4096:
                        yield pa.RecordBatch.from_pylist(made, schema=form)
                        made = []
                held.append(row)
        if held:
            made += work(held)
        if made:
            yield pa.RecordBatch.from_pylist(made, schema=form)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    form = to_arrow_schema(StructType.fromDDL(out))
    return rows.repartitionByRange("g", "sub").sortWithinPartitions("g", "sub", "pos").mapInArrow(walk, out)


def stored_levels(nodes: DataFrame, run: int = RUN, stride: int = STRIDE) -> list[DataFrame]:
    """The stored levels of the trees over nodes (g, n, pos, digest, ...), the given one first.

    Each next table holds the nodes ``stride`` levels up, or the root where one is left before, of groups that
    have several nodes in the table before.
    """
    size = run**stride

    def top(rows: list[dict]) -> Iterator[dict]:
        n = rows[0]["n"]
        made = subtree([r["digest"] for r in rows], levels_of(n, run, stride), run)[-1]
        yield {"g": rows[0]["g"], "n": -(-n // size), "pos": rows[0]["sub"], "digest": made[0]}

    tables = [nodes]
    most = nodes.agg(F.max("n")).first()[0] or 0
    while most > 1:
        several = tables[-1].where("n > 1").select("g", "n", "pos", "digest", F.floor(F.col("pos") / size).alias("sub"))
        tables.append(written(by_subtree(several, top, "g string, n long, pos long, digest string"), "merkle-level"))
        most = -(-most // size)
    return tables


def tops(tables: list[DataFrame]) -> DataFrame:
    """g, size, digest: the root of each group, and how many nodes its lowest level has."""
    sizes = tables[0].select("g", F.col("n").alias("size")).where("pos = 0")
    roots = None
    for t in tables:
        one = t.where("n = 1").select(F.col("g").alias("h"), "digest")
        roots = one if roots is None else roots.unionByName(one)
    return sizes.join(roots, F.col("g").eqNullSafe(F.col("h"))).select("g", "size", "digest")


PATH = "before array<string>, after array<string>, subroot string, root string"


def proofs(tables: list[DataFrame], above: DataFrame, run: int, stride: int, out: str, emit: Callable[[dict, list[str], list[str], dict], dict]) -> DataFrame:
    """One row of ``out`` for each node of the lowest table, as ``emit(node, before, after, above)`` makes it.

    ``before`` and ``after`` are the concatenated siblings left and right of the node and of each node
    above it, up to the subtree's top. ``above`` holds for each group (g, size, PATH) what stands
    beyond its root: siblings there, its root and the root of all.
    """
    size = run**stride

    def down(make: Callable[[dict, list[str], list[str], dict], dict]) -> Callable[[list[dict]], Iterator[dict]]:
        def work(rows: list[dict]) -> Iterator[dict]:
            over, own = rows[0], rows[1:]  # the path above has no place and comes first
            made = subtree([r["digest"] for r in own], levels_of(own[0]["n"], run, stride), run)
            sides: list[tuple[list[str], list[str]]] = [([], []) for _ in made[-1]]
            for level in reversed(made[:-1]):  # siblings of every node, from the top of the subtree down
                lower = []
                for i in range(len(level)):
                    at = i - i % run
                    before, after = sides[i // run]
                    lower.append((["".join(level[at:i]), *before], ["".join(level[i + 1 : at + run]), *after]))
                sides = lower
            for row, (before, after) in zip(own, sides, strict=True):
                yield make(row, before, after, over)

        return work

    def path(row: dict, before: list[str], after: list[str], over: dict) -> dict:
        return {"g": row["g"], "pos": row["pos"], "before": before + over["before"], "after": after + over["after"], "subroot": over["subroot"], "root": over["root"]}

    known: DataFrame | None = None
    for j in reversed(range(len(tables))):
        here, n = tables[j] if j == 0 else tables[j].where("n > 1"), F.ceil(F.col("size") / float(size**j))
        begins = above.where((n <= size) & ((n > 1) | F.lit(j == 0))).select("g", F.lit(0).cast("long").alias("sub"), *PATH_NAMES)
        if known is not None:
            begins = begins.unionByName(known.select("g", F.col("pos").alias("sub"), *PATH_NAMES))
        rows = here.withColumn("sub", F.floor(F.col("pos") / size)).unionByName(begins, allowMissingColumns=True)
        if j:
            known = written(by_subtree(rows, down(path), f"g string, pos long, {PATH}"), "merkle-paths")
        else:
            return by_subtree(rows, down(emit), out)
    raise ValueError("no tables")


PATH_NAMES = [c.split()[0] for c in PATH.split(", ")]


def merkle_manifest(docs: DataFrame, run: int = RUN, stride: int = STRIDE, siblings: bool = False) -> DataFrame:
    """doc_id, source, leaf, subroot, root, proof_sha256, folded_root, verified of every row of documents.

    A leaf is the digest of doc_id, source, lang, n_chars and text. The leaves of a source stand in order of doc_id,
    null first, rows that repeat one in order of their leaves; while several nodes are left, every ``run`` of them become
    their digest. A null source is a source. Sources stand in order of their bytes, null first, and their
    roots become the root of all in the same way. proof_sha256 is the digest of all siblings, level by level;
    ``siblings`` adds them as an array, one string for each level and side. folded_root is what the
    siblings make of the row's leaf, tampered with in a fifth of the rows, and verified says whether that is the root. An
    empty table gives an empty one; other columns are not read.
    """
    doc_id, source, lang, n_chars, text = F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("lang"), F.col("n_chars").cast("long"), F.col("text")
    picked, changed = tampered(doc_id, text)
    hashed = docs.select(
        source.alias("g"),
        doc_id.alias("doc_id"),
        leaf(doc_id, source, lang, n_chars, text).alias("digest"),
        F.when(picked, leaf(doc_id, source, lang, n_chars, changed)).alias("other"),
    )
    tables = stored_levels(written(placed(written(hashed, "merkle-leaves"), "doc_id", "digest", "other"), "merkle-level"), run, stride)
    roots = written(tops(tables), "merkle-roots")
    over = stored_levels(written(placed(roots.select(F.lit("").alias("g"), F.col("g").alias("source"), "size", "digest"), "source"), "merkle-level"), run, stride)
    root = over[-1].where("n = 1").select("digest").first()
    nothing = F.array().cast("array<string>")
    ends = tops(over).select("g", "size", nothing.alias("before"), nothing.alias("after"), F.lit(None).cast("string").alias("subroot"), F.lit(root[0] if root else None).cast("string").alias("root"))

    def of_source(row: dict, before: list[str], after: list[str], above: dict) -> dict:
        return {"g": row["source"], "size": row["size"], "before": before + above["before"], "after": after + above["after"], "subroot": row["digest"], "root": above["root"]}

    above = written(proofs(over, ends, run, stride, f"g string, size long, {PATH}", of_source), "merkle-above")

    def of_leaf(row: dict, before: list[str], after: list[str], above: dict) -> dict:
        before, after = before + above["before"], after + above["after"]
        steps = list(zip(before, after, strict=True))
        folded = row["other"] or row["digest"]
        for left, right in steps:
            folded = digest(left, folded, right)
        out = {"doc_id": row["doc_id"], "source": row["g"], "leaf": row["digest"], "subroot": above["subroot"], "root": above["root"]}
        out |= {"proof_sha256": digest(*(s for step in steps for s in step)), "folded_root": folded, "verified": folded == above["root"]}
        return out | {"siblings": [s for step in steps for s in step]} if siblings else out

    out = "doc_id long, source string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return proofs(tables, above, run, stride, out + ", siblings array<string>" * siblings, of_leaf)
