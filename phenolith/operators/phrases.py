"""Phrase discovery: candidate n-grams, lift in a focus class, registries and matrices."""

from __future__ import annotations

import contextlib
import ctypes
import re
import zlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lexicon import ATTRIBUTION, CODEBOOK, FUNCTION_WORDS, JUNK_WORDS, RUN_TOGETHER
from ..sources.staging import DIMENSION_ROWS, staged
from .dictionary import contained, needles
from .tagging import any_of

ADS = r"(?i)\b(?:subscribe|buy|discount|newsletter)\b"


def good_word(w: str) -> bool:
    """A word that may stand in a phrase: no short one, no function word, none that looks like several run together."""
    return 2 < len(w) <= 18 and w not in _FUNCTION and not _TOGETHER.search(w)


_FUNCTION, _JUNK, _TOGETHER = frozenset(FUNCTION_WORDS), frozenset(JUNK_WORDS), re.compile("|".join(RUN_TOGETHER))
_LETTERS = bytes(c if 97 <= c <= 122 else 32 for c in range(256))
#: Bytes of text taken at once, and words that a task remembers as good or not.
BLOCK_BYTES, KNOWN_WORDS = 2 << 20, 1 << 19


class _Words(dict):
    """Words by number: 0 for those that are not good, the others from 1 on; ``junk`` has the numbers of junk words."""

    def __init__(self) -> None:
        super().__init__()
        self.n, self.junk = 0, []

    def __missing__(self, w: bytes) -> int:
        text = w.decode()
        self.n += (good := good_word(text))
        if good and text in _JUNK:
            self.junk.append(self.n)
        self[w] = self.n if good else 0
        return self[w]


def _spans(texts: list[bytes], most: int, known: _Words) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """The words of all texts joined by spaces, and text, begin and end of each text's distinct phrases there, by their number of words and place.

    Phrases are told apart by the numbers of their words, one word more a round.
    """
    words: list[bytes] = []
    ends = np.zeros(len(texts) + 1, np.int64)
    for i, t in enumerate(texts):
        words += t.translate(_LETTERS).split()
        words.append(b"a")  # not good: no phrase goes on into the next text
        ends[i + 1] = len(words)
    if len(known) > KNOWN_WORDS:
        known.clear()
        known.__init__()
    number = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
    size = np.fromiter(map(len, words), np.int64, len(words))
    begin = np.cumsum(size + 1) - size - 1
    row = np.repeat(np.arange(len(texts)), np.diff(ends))
    telling = np.cumsum(np.concatenate([[0], (number > 0) & ~np.isin(number, known.junk)]))
    at = np.flatnonzero(number)
    same = np.unique(row[at] << 32 | number[at], return_inverse=True)[1]
    out = []
    for n in range(2, most + 1):
        going = number[at + n - 1] > 0  # the last word of all is none
        at, same = at[going], same[going]
        _, first, same = np.unique(same << 32 | number[at + n - 1], return_index=True, return_inverse=True)
        kept = at[np.sort(first)]
        kept = kept[telling[kept + n] > telling[kept]]
        out.append((row[kept], begin[kept], begin[kept + n - 1] + size[kept + n - 1]))
    row, begin, end = (np.concatenate(x) for x in zip(*out, strict=True))
    by = np.argsort(row, kind="stable")
    return b" ".join(words), row[by], begin[by], end[by]


def _lists(lengths: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), values)


def candidate_phrases(text: Column, most: int = 5) -> Column:
    """Distinct phrases of two to ``most`` neighbouring words that are all good and not all junk."""

    @F.arrow_udf("array<string>")
    def found(texts: pa.Array) -> pa.Array:
        known = _Words()
        parts = [_lists(np.bincount(of, minlength=n), _strings(joined, begin, end)) for _, n, joined, of, begin, end in _blocks(texts, most, known, BLOCK_BYTES)]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.string()))

    return found(F.lower(F.coalesce(text, F.lit(""))))


def _blocks(texts: pa.Array, most: int, known: _Words, size: int):
    """First row, rows, and spans of blocks of texts of about so many bytes."""
    row = 0
    sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    while row < len(texts):
        stop = max(row + 1, int(np.searchsorted(sizes, (sizes[row - 1] if row else 0) + size, "right")))
        yield row, stop - row, *_spans(texts.slice(row, stop - row).cast(pa.binary()).to_pylist(), most, known)
        row = stop


def _strings(joined: bytes, begin: np.ndarray, end: np.ndarray) -> pa.Array:
    at = np.concatenate([[0], np.cumsum(end - begin)])
    data = np.frombuffer(joined, np.uint8)[np.repeat(begin - at[:-1], end - begin) + np.arange(at[-1])]
    return pa.Array.from_buffers(pa.string(), len(begin), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data)])


#: Bits of the filter by which phrases that are too rare are left out before a shuffle: 16 MB, whatever the input.
FILTER_BITS = 27


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _hashes(strings: pa.Array, kind: str) -> np.ndarray:
    """64-bit hashes of strings of a kind, eight bytes a round; the same string has the same hash in any task. Nulls count as empty."""
    strings = pc.fill_null(strings, "").cast(pa.large_binary())
    _, offsets, data = strings.buffers()
    at = np.frombuffer(offsets, np.int64)[strings.offset : strings.offset + len(strings) + 1]
    raw = np.zeros((at[-1] if len(at) else 0) + 8, np.uint8)
    if data is not None:
        raw[: at[-1]] = np.frombuffer(data, np.uint8)[: at[-1]]
    return span_hashes(raw, at[:-1], np.diff(at), zlib.crc32(kind.encode()) << 32)


def span_hashes(raw: np.ndarray, begin: np.ndarray, size: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of spans of bytes, after the last of which eight more bytes stand."""
    each = np.ndarray(len(raw) - 7, "<u8", raw, 0, (1,))  # eight bytes from every place on
    place, left = begin.copy(), size.copy()
    h = left.astype(np.uint64) + np.uint64(seed)
    live = np.flatnonzero(left > 0)
    while live.size:
        keep = np.minimum(left[live], 8).astype(np.uint64) * np.uint64(8)
        h[live] = mix(h[live] ^ (each[place[live]] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - keep)))) * np.uint64(0x9E3779B97F4A7C15)
        place[live] += 8
        left[live] -= 8
        live = live[left[live] > 0]
    return mix(h)


def _flat(lists: pa.Array) -> tuple[np.ndarray, pa.Array]:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64), lists.flatten()


def phrase_hashes(phrases: Column, kind: str) -> Column:
    """Hashes of an array's phrases of a kind."""

    @F.arrow_udf("array<long>")
    def hashed(lists: pa.Array) -> pa.Array:
        lengths, strings = _flat(lists)
        return _lists(lengths, pa.array(_hashes(strings, kind).view(np.int64)))

    return hashed(phrases)


def _is_set(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    p = hashes & np.uint64((1 << FILTER_BITS) - 1)
    return (bits[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))) & np.uint64(1) > 0


def phrases_in(phrases: Column, kind: str, told) -> Column:
    """An array's phrases of a kind whose bit is set in the filter that was told to the tasks."""

    @F.arrow_udf("array<string>")
    def held(lists: pa.Array) -> pa.Array:
        lengths, strings = _flat(lists)
        keep = _is_set(told.value, _hashes(strings, kind))
        row = np.repeat(np.arange(len(lists)), lengths)[keep]
        return _lists(np.bincount(row, minlength=len(lists)), strings.filter(pa.array(keep)))

    return held(phrases)


def hash_filter(hashes: DataFrame, key: str = "h") -> np.ndarray:
    """2**FILTER_BITS bits, set where a hash falls. It serves as a filter before an exact step: a set bit says nothing certain."""
    place = F.pmod(key, F.lit(1 << FILTER_BITS))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("p", F.lit(64)).cast("int"))
    words = hashes.select(place.alias("p")).groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(bit).alias("b")).toArrow()
    out = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    out[words["w"].to_numpy()] = words["b"].to_numpy().view(np.uint64)
    return out


def hash_told(h: Column, told) -> Column:
    """Whether a hash's bit is set in the filter that was told to the tasks; not for nulls."""

    @F.arrow_udf("boolean")
    def held(hashes: pa.Array) -> pa.Array:
        bits = _is_set(told.value, pc.fill_null(hashes, 0).to_numpy(zero_copy_only=False).view(np.uint64))
        return pc.and_(pa.array(bits), hashes.is_valid())

    return held(h)


def sifted(df: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of df whose doc_id is one of ids, with few others: what a join with ids that follows need not shuffle."""
    told = df.sparkSession.sparkContext.broadcast(hash_filter(ids.select(F.xxhash64("doc_id").alias("h"))))
    return df.where(hash_told(F.xxhash64("doc_id"), told))


def _occurrences(batch: pa.RecordBatch, kinds: Sequence[str], texts: Sequence[str], known: _Words):
    """Kind, rows of the batch, hashes, and what gives the strings at places, of the phrases in a batch's columns, a block at a time.

    Columns among ``texts`` have texts, others arrays. Of texts, no phrase becomes a string before it is asked for.
    """
    for i, k in enumerate(kinds):
        column = batch.column(k)
        if k in texts:
            for row, _, joined, of, begin, end in _blocks(column, 5, known, FOUND_BYTES):
                hashes = span_hashes(np.frombuffer(joined + bytes(8), np.uint8), begin, end - begin, zlib.crc32(k.encode()) << 32)
                yield i, row + of, hashes, lambda at, joined=joined, begin=begin, end=end: _strings(joined, begin[at], end[at])
        else:
            lengths, strings = _flat(column)
            told = strings.is_valid()
            row, strings = np.repeat(np.arange(len(column)), lengths)[told.to_numpy(zero_copy_only=False)], strings.filter(told)
            yield i, row, _hashes(strings, k), lambda at, strings=strings: strings.take(pa.array(at))


#: Bytes of text taken at once where an executor's tasks each search beside its JVM; hashes and rows that a task holds before it sends them.
FOUND_BYTES, HELD_HASHES, HELD_ROWS = 1 << 20, 1 << 20, 1 << 17
#: Bits of a hash by which phrases are counted, the first of which are the part that counts them.
COUNTED_BITS, PART_BITS = 32, 12
#: Parts of the phrases that are summed one after another, at least.
PHRASE_PARTS = 512
_ESCAPE = 0xFFFF


def _packed(ids: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Parts of sorted ids, where they begin in the packed steps and end, and the steps: two bytes each, ESCAPE where one goes on. No id more than ``most`` times."""
    ids = ids[np.concatenate([np.ones(min(most, len(ids)), bool), ids[most:] != ids[:-most]])]
    part = ids >> (COUNTED_BITS - PART_BITS)
    first = np.flatnonzero(np.diff(part, prepend=-1))
    step = np.diff(ids, prepend=0)
    step[first] = ids[first] & ((1 << (COUNTED_BITS - PART_BITS)) - 1)
    last = np.cumsum(step // _ESCAPE + 1)
    steps = np.full(last[-1] if len(last) else 0, _ESCAPE, np.uint16)
    steps[last - 1] = step % _ESCAPE
    return part[first], np.concatenate([last[first] - step[first] // _ESCAPE - 1, last[-1:]]), steps


def _unpacked(data: bytes) -> np.ndarray:
    steps = np.frombuffer(data, np.uint16)
    return np.cumsum(steps, dtype=np.int64)[steps != _ESCAPE]


def frequent_filter(docs: DataFrame, least: dict[str, int], texts: Sequence[str] = ()) -> np.ndarray:
    """The bits of ``hash_filter`` for phrases that stand in at least so many rows of docs, and for few others.

    Phrases are told by 32 bits of their hashes, of which 27 are their bit's place; rare ones that share them only add to a count. A task
    sorts them and sends steps between neighbours, about two bytes a phrase, one row for each part of the places. Parts are counted
    one after another, and so need no more memory than one part's ids.
    """
    kinds = list(least)
    local = COUNTED_BITS - FILTER_BITS  # bits besides the place

    def send(batches):
        known, held = _Words(), [[] for _ in kinds]

        def sent(i: int):
            ids, held[i] = np.sort(np.concatenate(held[i])).astype(np.int64), []
            part, at, steps = _packed(ids, least[kinds[i]])
            data = pa.Array.from_buffers(pa.binary(), len(part), [None, pa.py_buffer((at * 2).astype(np.int32)), pa.py_buffer(steps)])
            yield pa.RecordBatch.from_arrays([pa.array((part + (i << PART_BITS)).astype(np.int32)), data], ["part", "steps"])

        for batch in batches:
            for i, _, h, _ in _occurrences(batch, kinds, texts, known):
                held[i].append(((h & np.uint64((1 << FILTER_BITS) - 1)) << np.uint64(local) | h >> np.uint64(64 - local)).astype(np.uint32))
                if sum(map(len, held[i])) >= HELD_HASHES:
                    yield from sent(i)
        for i in range(len(kinds)):
            if sum(map(len, held[i])):
                yield from sent(i)
        _given_back()

    def count(batches):
        part, ids, counts, more = None, np.zeros(0, np.int64), np.zeros(0, np.int64), []

        def summed():
            every = np.concatenate([ids, *more])
            by = np.argsort(every, kind="stable")
            first = np.flatnonzero(np.diff(every[by], prepend=-1))
            one = np.concatenate([counts, np.ones(len(every) - len(ids), np.int64)])[by]
            return every[by][first], np.add.reduceat(one, first) if len(first) else one

        def frequent(ids: np.ndarray, counts: np.ndarray):
            place = np.unique(ids[counts >= least[kinds[part >> PART_BITS]]] >> local)
            bits = np.zeros(1 << (FILTER_BITS - PART_BITS), bool)
            bits[place] = True
            return pa.RecordBatch.from_pydict({"part": pa.array([part & ((1 << PART_BITS) - 1)], pa.int32()), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()] if len(place) else [None], pa.binary())})

        for batch in batches:
            for p, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if p != part and part is not None:
                    yield frequent(*summed())
                    ids, counts, more = np.zeros(0, np.int64), np.zeros(0, np.int64), []
                part = p
                more.append(_unpacked(data.as_buffer()))
                if sum(map(len, more)) >= HELD_HASHES:
                    ids, counts = summed()
                    more = []
        if part is not None:
            yield frequent(*summed())

    sent = docs.select(*kinds).mapInArrow(send, "part int, steps binary")
    bits = sent.repartition("part").sortWithinPartitions("part").mapInArrow(count, "part int, bits binary").where("bits is not null").toArrow()
    out = np.zeros((1 << PART_BITS, 1 << (FILTER_BITS - PART_BITS - 6)), np.uint64)
    for part, data in zip(bits.column(0).to_pylist(), bits.column(1), strict=True):
        out[part] |= np.frombuffer(data.as_buffer(), np.uint64)
    return out.ravel()


#: Smallest count in the focus class and smallest lift of a phrase, by its type.
FLOORS = {"noun_phrase": (15, 1.3), "verb_phrase": (7, 1.3), "attribution": (3, 1.0), "attribution_place": (3, 1.0), "attribution_product": (3, 1.0)}


def _given_back() -> None:
    """Memory that was freed goes back to the system: workers wait between tasks, and beside others that search."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # glibc alone has it
        ctypes.CDLL(None).malloc_trim(0)


_GROUPS = ["kind", "phrase", "country", "individual"]


def _paged(sums: pa.Table):
    """A row for each part of the table: the part, and its rows packed."""
    sums = sums.take(pc.sort_indices(sums, sort_keys=[("part", "ascending")])).combine_chunks()
    part = sums["part"].to_numpy()
    first = np.flatnonzero(np.diff(part, prepend=-1))
    rows, codec, pages, sizes = sums.drop_columns(["part"]), pa.Codec("zstd"), [], []
    for a, b in zip(first, [*first[1:], len(part)], strict=True):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rows.schema) as out:
            out.write_table(rows.slice(a, b - a))
        sizes.append(len(page := sink.getvalue()))
        pages.append(codec.compress(page, asbytes=True))
    yield pa.RecordBatch.from_arrays([pa.array(part[first], pa.int32()), pa.array(sizes, pa.int32()), pa.array(pages, pa.binary())], ["part", "size", "page"])


def _summed(parts: list[pa.Table], more: Sequence[str] = ()) -> pa.Table:
    groups = [*_GROUPS, *more]
    sums = pa.concat_tables(parts).group_by(groups, use_threads=False).aggregate([("n_focus", "sum"), ("n", "sum"), ("w", "sum")])
    return sums.select([*groups, "n_focus_sum", "n_sum", "w_sum"]).rename_columns([*groups, "n_focus", "n", "w"])


def phrase_lift(docs: DataFrame, floors: dict[str, tuple[int, float]] = FLOORS, texts: Sequence[str] = (), labels: DataFrame | None = None) -> DataFrame:
    """feature_type, phrase with its counts, lift, breadth and rank value.

    docs has focus, weight, country, individual, and an array of phrases in the column of each type that
    it has of ``floors``; of types among ``texts`` the column has a text, whose ``candidate_phrases`` are found where they are
    counted, so that no array of all of them is made. With ``labels`` (doc_id, focus), docs has doc_id and is joined with them for
    its focus: texts of documents that have no label are not shuffled, and none for the first count.
    Only phrases that reach their floor in the focus class can stay: they are counted
    first by their hashes, over the texts of that class alone, and make a filter of fixed size that the tasks hold; of the corpus only phrases
    that pass it are shuffled, once and by parts of their hashes, and phrases that pass by chance fall out by their exact counts. Before, a
    task sums them by phrase, country and person and packs the sums of a part. Distinct countries and people are counted
    from these sums, one part after another.
    The totals are one row.
    """
    kinds = [k for k in floors if k in docs.columns]
    spark, least = docs.sparkSession, {k: floors[k][0] for k in kinds}
    each = [F.lower(F.coalesce(k, F.lit(""))).alias(k) if k in texts else F.array_distinct(F.coalesce(k, F.array().cast("array<string>"))).alias(k) for k in kinds]
    about = [F.coalesce("focus", F.lit(False)).alias("focus"), F.col("weight").cast("double").alias("weight"), *(F.col(c).cast("string").alias(c) for c in ("country", "individual"))]
    if labels is not None and labels.limit(DIMENSION_ROWS + 1).count() <= DIMENSION_ROWS:
        docs, labels = docs.join(F.broadcast(labels), "doc_id", "left"), None
    if labels is None:
        totals, some = docs, frequent_filter(docs.where("focus").select(*each), least, texts)
    else:
        totals, h = docs.select("doc_id").join(labels, "doc_id", "left"), F.xxhash64("doc_id").alias("h")
        known = spark.sparkContext.broadcast(hash_filter(labels.select(h)))
        often = labels.where("focus").groupBy("doc_id").count().agg(F.max("count")).first()[0] or 1  # a text counts once here, but once a label in the join
        some = frequent_filter(sifted(docs, labels.where("focus")).select(*each), {k: -(-n // often) for k, n in least.items()}, texts)
    some, parts = spark.sparkContext.broadcast(some), max(PHRASE_PARTS, 16 * int(spark.conf.get("spark.sql.shuffle.partitions")))

    def find(batches):
        words, held, n = _Words(), [], 0
        for batch in batches:
            of_doc = pa.table({"country": batch.column("country"), "individual": batch.column("individual"), "n_focus": batch.column("focus").cast(pa.int64()), "w": batch.column("weight")})
            for i, row, h, strings in _occurrences(batch, kinds, texts, words):
                at = np.flatnonzero(_is_set(some.value, h))
                row = of_doc.take(pa.array(row[at])).append_column("phrase", strings(at)).append_column("n", pa.array(np.ones(len(at), np.int64)))
                part = ((h[at] >> np.uint64(33)) % np.uint64(parts)).astype(np.int32)
                held.append(row.append_column("kind", pa.array(np.full(len(at), i, np.int32))).append_column("part", pa.array(part)))
                n += len(at)
                if n >= HELD_ROWS:
                    yield from _paged(_summed(held, ["part"]))
                    held, n = [], 0
        if n:
            yield from _paged(_summed(held, ["part"]))
        held.clear()
        _given_back()

    def count(batches):
        codec, last, held, n = pa.Codec("zstd"), None, [], 0

        def counted():
            sums, valid = _summed(held), pc.CountOptions("only_valid")
            sums = sums.append_column("place", pc.if_else(pc.greater(sums["n_focus"], 0), sums["country"], pa.scalar(None, pa.string())))
            by = sums.group_by(["kind", "phrase"], use_threads=False).aggregate([("n_focus", "sum"), ("n", "sum"), ("w", "sum"), ("place", "count_distinct", valid), ("individual", "count_distinct", valid)])
            by = by.select(["kind", "phrase", "n_focus_sum", "n_sum", "w_sum", "place_count_distinct", "individual_count_distinct"])
            by = by.rename_columns(["kind", "phrase", "freq_focus", "freq_all", "w", "n_countries", "n_individuals"])
            return by.filter(pa.array(by["freq_focus"].to_numpy() >= np.array(list(least.values()))[by["kind"].to_numpy()])).to_batches()

        for batch in batches:
            for part, size, page in zip(*(batch.column(c) for c in ("part", "size", "page")), strict=True):
                if part.as_py() != last and held:
                    yield from counted()
                    held, n = [], 0
                last = part.as_py()
                held.append(pa.ipc.open_stream(codec.decompress(page.as_buffer(), size.as_py())).read_all())
                n += len(held[-1])
                if n >= 2 * HELD_ROWS:
                    held, n = [_summed(held)], 0
                    _given_back()
        if held:
            yield from counted()
        held.clear()
        _given_back()

    if labels is not None:
        told = hash_told(F.xxhash64("doc_id"), known)
        docs = docs.where(~told).withColumn("focus", F.lit(False)).unionByName(docs.where(told).join(labels, "doc_id", "left"))
    pages = docs.select(*about, *each).mapInArrow(find, "part int, size int, page binary")
    by = pages.repartition("part").sortWithinPartitions("part").mapInArrow(count, "kind int, phrase string, freq_focus long, freq_all long, w double, n_countries long, n_individuals long")
    one = totals.agg(F.sum(F.coalesce("focus", F.lit(False)).cast("int")).alias("n_focus"), F.count("*").alias("n_all"))
    lift = (F.col("freq_focus") / F.greatest("n_focus", F.lit(1))) / (F.col("freq_all") / F.greatest("n_all", F.lit(1)))
    kept = by.crossJoin(F.broadcast(one)).withColumn("lift", lift).where(F.col("lift") >= F.element_at(F.array(*(F.lit(float(floors[k][1])) for k in kinds)), F.col("kind") + 1))
    score = F.round(F.col("lift") * F.log(F.col("n_individuals") + 1) + 1e-9, 4)
    kind = F.element_at(F.array(*map(F.lit, kinds)), F.col("kind") + 1).alias("feature_type")
    return kept.select(kind, "phrase", "freq_focus", "freq_all", F.round(F.col("w") + 1e-9, 2).alias("weighted"), F.round(F.col("lift") + 1e-9, 3).alias("lift"), "n_countries", "n_individuals", score.alias("population_score"))


def topk_registry(lift: DataFrame, k: int) -> DataFrame:
    """The k phrases of each feature type by score and weight."""
    order = Window.partitionBy("feature_type").orderBy(F.desc(F.round(F.col("population_score") * F.sqrt("weighted"), 6)), "phrase")
    return lift.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def concept_match(phrases: DataFrame, codebook: dict[str, tuple[int, str, list[str]]] = CODEBOOK) -> DataFrame:
    """phrase, concept, tier, category: the first concept of the codebook (in its order) with a keyword that the phrase contains.

    One walk a phrase finds all keywords. Phrases without one are left out; repeated ones count once.
    """
    concepts = F.array(*(F.struct(F.lit(c).alias("concept"), F.lit(t).alias("tier"), F.lit(k).alias("category")) for c, (t, k, _) in codebook.items()))
    first = F.array_min(contained(F.lower("phrase"), [w for _, _, w in codebook.values()]))
    hits = phrases.select("phrase").distinct().withColumn("i", first).where("i is not null")
    return hits.select("phrase", F.element_at(concepts, F.col("i") + 1).alias("c")).select("phrase", "c.*")


def feature_vectors(docs: DataFrame, registry: DataFrame, phrases: str = "phrases", most: int = 100_000, text: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Sparse rows of registry phrases, and the vocabulary (phrase, column) they are written in.

    docs has doc_id and an array of phrases, and with ``text`` a text whose ``candidate_phrases`` count too; of them only those of the
    registry become strings. registry has phrase and n_countries. Columns are numbered from 0 in
    order of the phrases. The first result has doc_id, ``columns`` (ascending), and ``cross_cultural``: whether one of its phrases is known
    from two countries or more. The vocabulary is written once to the shared folder, so that other tables can be
    put in the same columns; it is a dimension of at most ``most`` phrases, beyond which it is an error.
    """
    words = staged(registry.groupBy("phrase").agg(F.max("n_countries").alias("n_countries")).limit(most + 1), "registry")
    if words.count() > most:
        raise ValueError(f"a registry of more than {most} phrases has no columns")
    vocabulary = staged(words.withColumn("column", F.row_number().over(Window.orderBy("phrase")) - 1), "vocabulary")  # one task, bounded by most
    in_order = vocabulary.where("phrase is not null").select("phrase", "column", F.coalesce(F.col("n_countries") >= 2, F.lit(False)).alias("cross")).toArrow()
    told = docs.sparkSession.sparkContext.broadcast([c.to_pylist() for c in in_order.columns])
    kinds = [phrases, *([text] if text else [])]

    def find(batches):
        words, number, cross = pa.array(told.value[0], pa.string()), np.array(told.value[1], np.int64), np.array(told.value[2], bool)
        hashes, known = [_hashes(words, k) for k in kinds], _Words()
        for batch in batches:
            pairs, is_cross = [np.zeros(0, np.int64)], np.zeros(len(batch), bool)
            for i, row, h, strings in _occurrences(batch, kinds, [text], known):
                at = np.flatnonzero(np.isin(h, hashes[i]))
                word = pc.fill_null(pc.index_in(strings(at), words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
                row, word = row[at][word >= 0], word[word >= 0]
                pairs.append(row << 32 | number[word])
                is_cross[row[cross[word]]] = True
            pair = np.unique(np.concatenate(pairs))
            columns = _lists(np.bincount(pair >> 32, minlength=len(batch)), pa.array((pair & 0xFFFFFFFF).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), columns, pa.array(is_cross)], ["doc_id", "columns", "cross_cultural"])
        _given_back()

    of_doc = F.col("doc_id").isNotNull()
    each = [F.array_distinct(F.coalesce(F.when(of_doc, F.col(phrases)), F.array().cast("array<string>"))).alias(phrases), *([F.lower(F.coalesce(F.when(of_doc, F.col(text)), F.lit(""))).alias(text)] if text else [])]
    rows = docs.select("doc_id", *each).mapInArrow(find, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, columns array<int>, cross_cultural boolean")
    merged = F.array_sort(F.array_distinct(F.flatten(F.collect_list("columns"))))
    return rows.groupBy("doc_id").agg(merged.alias("columns"), F.max("cross_cultural").alias("cross_cultural")), vocabulary


def feature_matrix(docs: DataFrame, words: Sequence[str], text: str = "text") -> DataFrame:
    """doc_id, one 0/1 column for each registry word, and whether any is set: a projection, as the registry is given."""
    tokens = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z]+)"), 1))
    flagged = docs.select("doc_id", tokens.alias("t")).select("doc_id", *(F.array_contains("t", w).cast("int").alias(f"f_{w}") for w in words))
    return flagged.withColumn("any_feature", F.greatest(*(F.col(f"f_{w}") for w in words)) == 1)


def attribution_phrases(text: Column) -> Column:
    """What a long life is put down to: the trimmed objects of all patterns, without advertising.

    No match goes beyond a ``.;!?``, so the patterns are tried on those stretches alone that hold a string which one of
    their matches has to hold.
    """
    signs = sorted({n for p in ATTRIBUTION for n in needles(p)})
    told = F.array_join(F.filter(F.split(text, "[.;!?]"), lambda x: any_of(F.lower(x), signs)), ". ")
    hits = F.element_at(F.transform(F.array(told), lambda t: F.concat(*(F.regexp_extract_all(t, F.lit(p), 1) for p in ATTRIBUTION))), 1)  # bound as a variable, the stretches are found once
    found = F.array_distinct(F.transform(hits, lambda x: F.trim(x)))  # trim itself would take the index as its second parameter
    return F.filter(found, lambda x: F.length(x).between(4, 80) & ~x.rlike(ADS))
