"""Packing documents into as few sequences of a fixed number of tokens as possible.

The instance of the packing problem is the histogram of lengths: at most ``capacity`` numbers,
however many documents there are. The Martello-Toth dominance reduction and the best-fit of
what it leaves run on that histogram and give patterns with multiplicities; the documents then
take their places by their rank among those of the same length, in a join with a table whose
size ``capacity`` bounds as well.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bytescan import process_held, text_batches
from .storage import written

CAPACITY = 4096
END_ID = 1
#: Rows of one length and salt that one window sorts.
SALT_ROWS = 20_000
#: Bytes of runs and their ids that a worker holds, at most; longer runs than LONG_RUN are not held.
HELD_BYTES, LONG_RUN = 192 << 20, 4096
#: What a held run costs beside its bytes.
ENTRY = 160
#: A mark after a letter (a-z or Latin-1) and before white space.
MARK = re.compile(rb"(?:(?<=[a-z])|(?<=\xc3[\x9f-\xb6\xb8-\xbf]))([,.])(?=[ \n])")
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


# -- token ids -------------------------------------------------------------------------------


class _Held(dict):
    """Ids of runs of characters, as little-endian uint32 bytes; the library is asked on a miss."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        self.bytes = 0
        self.by_runs = self._splits()

    def ids(self, text: str) -> bytes:
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def _splits(self) -> bool:
        """Whether the ids of texts are those of their runs, small letters and marks apart, as far as texts that would show it tell."""
        probes = ["Ab cd", "one, two. three", "xé,\nß. y", " a  b\tc\n", "A,b .c Ünï, x1, 2. z", "don't stop-it (now), e.g. U.S. 3,000.5"]
        return all(self.ids(p) == b"".join(self.ids(w.decode()) for w in MARK.sub(rb" \1", p.encode().lower()).split()) for p in probes)

    def __missing__(self, run: bytes) -> bytes:
        ids = self.ids(run.decode())
        if len(run) <= LONG_RUN:
            self.bytes += len(run) + len(ids) + ENTRY
            if self.bytes > HELD_BYTES:
                self.clear()
                self.bytes = len(run) + len(ids) + ENTRY
            self[run] = ids
        return ids


def encoder(path: str) -> Callable[[bytes], bytes]:
    """Ids of a text as little-endian uint32 bytes.

    No token of a tokenizer that drops white space crosses it, so the ids of a text are those of its
    runs of other characters. A comma or full stop between a letter and white space is a word of its
    own, and A-Z may as well be lower-cased here, unless special strings stand in the text; that
    makes many runs equal. What the library gave for a run is held, in bounded bytes, beyond the task. A tokenizer
    that does not split texts so (``_splits``) gets whole texts.
    """
    state = process_held(("ids", path))
    if not state:
        state["held"] = _Held(path)
    get = state["held"].__getitem__

    held = state["held"]
    if not held.by_runs:
        return lambda text: held.ids(text.decode())

    def encode(text: bytes) -> bytes:
        if b"<|" not in text:
            text = MARK.sub(rb" \1", text.lower())
        return b"".join(map(get, text.split()))

    return encode


def _cut(ids: bytes, capacity: int) -> Iterator[tuple[int, bytes]]:
    step = 4 * capacity
    for k in range(0, len(ids), step):
        yield k // 4, ids[k : k + step]


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Cuts each document's ids (its text's, then ``end_id``) into pieces of at most ``capacity``.

    Only documents longer than ``capacity`` are cut, the last piece may be shorter. A null text is
    empty: one piece with ``end_id`` alone. Repeated rows give repeated pieces. ``with_ids`` adds
    the ids themselves. An empty table gives an empty one. Other columns are not carried.
    """
    schema = PIECES + (", ids array<int>" if with_ids else "")
    tail = array("I", [end_id]).tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_text = encoder(tokenizer_path)
        for batch, data, at in text_batches(batches):
            raw = data.tobytes()
            rows: list[list] = [[], [], [], [], [], []]
            for doc, a, b in zip(batch.column(0).to_pylist(), at[:-1], at[1:], strict=True):
                for k, (start, part) in enumerate(_cut(encode_text(raw[a:b]) + tail, capacity)):
                    for column, value in zip(rows, (doc, k, start, len(part) // 4, zlib.crc32(part), np.frombuffer(part, "<i4") if with_ids else None), strict=True):
                        column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()))
            names = ("doc_id", "piece", "start", "length", "ids_crc32", "ids")
            keep = 6 if with_ids else 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows[:keep], kinds, strict=False)], names=list(names[:keep]))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(encode, schema)


# -- the packing problem on a histogram ------------------------------------------------------

Pattern = tuple[tuple[int, int], ...]


def _largest(count: np.ndarray, most: int) -> int:
    """The largest length of at most ``most`` that some item has, else 0."""
    found = np.flatnonzero(count[: most + 1])
    return int(found[-1]) if found.size else 0


def _smallest(count: np.ndarray, without: int, n: int) -> list[int]:
    """The n smallest items besides one of length ``without``, padded with a value beyond all."""
    out: list[int] = []
    for s in np.flatnonzero(count)[: n + 1]:
        out += [int(s)] * min(n, int(count[s]) - (s == without))
    return (out + [1 << 60] * n)[:n]


def _best_pair(count: np.ndarray, without: int, most: int) -> int:
    """The largest sum of at most ``most`` of two items besides one of length ``without``."""
    sizes = [(int(s), int(count[s]) - (s == without)) for s in np.flatnonzero(count[: most + 1])]
    sizes = [x for x in sizes if x[1] > 0]
    low, high, best = 0, len(sizes) - 1, 0
    while low <= high:
        total = sizes[low][0] + sizes[high][0]
        if total <= most and (low != high or sizes[low][1] > 1):
            best = max(best, total)
        low, high = (low + 1, high) if total <= most else (low, high - 1)
    return best


def dominance_reduction(count: np.ndarray, capacity: int) -> list[tuple[Pattern, int]]:
    """Fixes bins that some optimal packing has and takes their items out of ``count``.

    For an item j with room r beside it: if nothing else fits, j stays alone; an item of exactly
    r dominates every other filling; if no two others fit together, the largest that fits does;
    if no three do and no pair fills more than the largest single one, that one does. Each rule
    is applied to all items of a length at once, over and over until none applies.
    """
    fixed: list[tuple[Pattern, int]] = []

    def fix(j: int, k: int) -> bool:
        n = int(count[j]) // 2 if j == k else int(min(count[j], count[k]) if k else count[j])
        if n:
            fixed.append((((j, 2),) if j == k else ((j, 1), (k, 1)) if k else ((j, 1),), n))
            count[j] -= n
            if k:
                count[k] -= n
        return n > 0

    changed = True
    while changed:
        changed = False
        for j in map(int, np.flatnonzero(count)[::-1]):
            while count[j]:
                room = capacity - j
                a, b, c = _smallest(count, j, 3)
                if a > room:
                    k = 0
                elif count[room] - (room == j) > 0:
                    k = room
                else:
                    count[j] -= 1
                    k = _largest(count, room)
                    count[j] += 1
                    if a + b <= room and not (a + b + c > room and k >= _best_pair(count, j, room)):
                        break
                if not fix(j, k):
                    break
                changed = True
    return fixed


def best_fit(count: np.ndarray, capacity: int) -> list[tuple[Pattern, int]]:
    """Best-fit by falling length; bins of one pattern are filled together."""
    open_: dict[int, list[tuple[Pattern, int]]] = {}
    bins = np.zeros(capacity + 1, bool)

    def put(pattern: Pattern, room: int, n: int) -> None:
        if n:
            open_.setdefault(room, []).append((pattern, n))
            bins[room] = True

    for s in map(int, np.flatnonzero(count)[::-1]):
        left = int(count[s])
        while left:
            rooms = np.flatnonzero(bins[s:])
            room = int(rooms[0]) + s if rooms.size else capacity
            pattern, n = open_[room].pop() if rooms.size else ((), left)
            each = min(room // s, left)
            full = min(n, left // each)
            put((*pattern, (s, each)), room - s * each, full)
            put(pattern, room, n - full if rooms.size else 0)
            bins[room] = bool(open_.get(room))
            left -= full * each
    count[:] = 0
    return [x for group in open_.values() for x in group]


def packing_plan(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int, int]], dict[str, int]]:
    """Rows (length, first rank, rank after the last, first sequence, places of the length in each, offset) and figures."""
    count = np.zeros(capacity + 1, np.int64)
    for s, n in counts.items():
        count[s] = n
    fixed = dominance_reduction(count, capacity)
    left = int(count.sum())
    groups = fixed + best_fit(count, capacity)
    rows, sequence, rank = [], 0, dict.fromkeys(counts, 0)
    for pattern, n in groups:
        offset = 0
        for s, each in pattern:
            rows.append((s, rank[s], rank[s] + n * each, sequence, each, offset))
            rank[s] += n * each
            offset += s * each
        sequence += n
    return rows, {"sequences": sequence, "fixed": sum(n for _, n in fixed), "left_items": left}


# -- the documents -----------------------------------------------------------------------------


def pack(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """items (with ``doc_id``, ``piece``, ``length`` from 1 to ``capacity``) with ``sequence_id`` and ``offset``.

    ``items`` is read three times and should be a written table. Equal lengths are told apart by
    their rank; lengths that many items share are ranked in salted parts, so none is sorted in one
    task. Items with equal keys (repeated rows) take the places in any order, which gives the same
    rows. An empty table gives an empty one.
    """
    spark = items.sparkSession
    counts = {r["length"]: r["n"] for r in items.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    plan, _ = packing_plan(counts, capacity)
    salts = F.broadcast(spark.createDataFrame([(s, -(-n // SALT_ROWS)) for s, n in counts.items()], "length long, salts long"))
    places = F.broadcast(spark.createDataFrame(plan, "length long, first long, after long, first_sequence long, each long, first_offset long"))
    salted = items.join(salts, "length").withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), "salts")).drop("salts")
    before = (
        salted.groupBy("length", "salt")
        .agg(F.count("*").alias("n"))
        .withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)))
        .select("length", "salt", F.coalesce("before", F.lit(0)).alias("before"))
    )
    within = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", *[c for c in ("ids_crc32",) if c in items.columns]))
    ranked = salted.withColumn("within", within).join(before, ["length", "salt"]).withColumn("rank", F.col("before") + F.col("within") - 1)
    at = F.col("rank") - F.col("first")
    return (
        ranked.join(places, (ranked["length"] == places["length"]) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("after")))
        .drop(places["length"])
        .withColumn("sequence_id", F.col("first_sequence") + F.floor(at / F.col("each")))
        .withColumn("offset", F.col("first_offset") + F.pmod(at, F.col("each")) * F.col("length"))
        .select(*items.columns, "sequence_id", "offset")
    )


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` of docs, encoded once, in the sequences that ``pack`` gives them. An empty table gives an empty one."""
    return pack(written(pieces(docs, tokenizer_path, capacity), "pieces"), capacity)
