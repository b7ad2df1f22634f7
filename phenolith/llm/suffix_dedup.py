"""Removal of byte strings that repeat across documents, by suffix arrays of shards.

A string of ``length`` bytes (50) always holds the same anchor: the smallest-hash k-gram among
those that start in it (winnowing). So

1. anchors are counted across documents, pre-aggregated per batch of texts, and those that only
   one document holds are dropped; nothing that repeats is lost by that;
2. each run of strings around another anchor goes to the shard of the anchor's hash, where all
   equal strings meet. Runs that are equal as wholes become one segment with the smallest of their
   documents. The segments of a shard get one suffix array by induced sorting, and its permuted
   common prefixes tell which suffixes share ``length`` bytes. An anchor whose runs are all equal
   makes a single segment, in which there is nothing to sort;
3. anchors of very many runs (hot ones) skip the shards: equal runs are told by their hashes,
   the strings of different ones are hashed one by one, and their smallest document is found with
   pre-aggregated minima, so no group is gathered;
4. the spans found are joined to their documents, merged, and cut out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytescan import BLOCK, EXACT, gathered, mix, rolling, span_hashes, text_batches
from .storage import bitmap, in_bitmap, written

LENGTH = 50
GRAM = 16
ANCHOR_BITS = 27
DOC_BITS = 24
#: An anchor with more runs than one task should sort is hot, whatever the size of the input. The set of
#: hot anchors is broadcast and holds at most MAX_HOT: with so many runs in all that it would hold more, an
#: anchor needs one in MAX_HOT of them.
HOT_ROWS = 32768
MAX_HOT = 1 << 24
#: Bytes of runs that get one suffix array, in whole anchors; sorting takes some 120 bytes of memory for each, and as long a byte in larger shards.
SHARD_BYTES = 1 << 20
PAST = np.uint64(257)


# -- anchors ------------------------------------------------------------------------------------


class Runs(NamedTuple):
    """Runs of neighbouring strings that have the same anchor."""

    row: np.ndarray  # of the batch
    hash: np.ndarray  # of the anchor
    first: np.ndarray  # where the first string starts in its text
    count: np.ndarray  # strings
    place: np.ndarray  # of the first in the buffer


def _runs(data: np.ndarray, at: np.ndarray, length: int, k: int) -> Runs:
    """Of one buffer of at most a block."""
    width = length - k + 1
    h = rolling(data, k)
    n = len(h) - width + 1
    if n < 1:
        return Runs(*(np.zeros(0, t) for t in (np.int64, np.uint64, np.int64, np.int64, np.int64)))
    least, covered = h, 1
    while covered < width:  # sliding minimum by doubling
        shift = min(covered, width - covered)
        least = np.minimum(least[:-shift], least[shift:])
        covered += shift
    inside = np.zeros(n + 1, np.int32)  # strings that one text holds
    full = np.diff(at) >= length
    np.add.at(inside, at[:-1][full], 1)
    np.add.at(inside, at[1:][full] - length + 1, -1)
    inside = np.cumsum(inside[:-1]) > 0
    # another anchor: the minimum changes, or it leaves while an equal one stays, or a text begins
    fresh = np.empty(n, bool)
    fresh[0] = True
    np.not_equal(least[1:], least[:-1], out=fresh[1:])
    fresh[1:] |= h[: n - 1] == least[1:]
    fresh[at[:-1][full]] = True
    first = np.flatnonzero(fresh & inside)
    row = np.searchsorted(at, first, "right") - 1
    after = np.append(first[1:], n)
    count = np.minimum(after, at[row + 1] - length + 1) - first
    return Runs(row, least[first], first - at[row], count, first)


def runs_of(batches: Iterator[pa.RecordBatch], length: int, k: int = GRAM) -> Iterator[tuple[np.ndarray, np.ndarray, Runs]]:
    """doc_ids, buffer and runs, a part of a batch at a time; long texts in blocks that overlap by a string."""
    for batch, data, at in text_batches(batches, most=BLOCK):
        ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        if len(data) <= BLOCK:
            yield ids, data, _runs(data, at, length, k)
            continue
        for row in range(len(at) - 1):
            text, step = data[at[row] : at[row + 1]], BLOCK - length
            for begin in range(0, max(1, len(text) - length + 1), step):
                part = text[begin : begin + step + length - 1]
                found = _runs(part, np.array([0, len(part)]), length, k)
                yield ids[row : row + 1], part, found._replace(first=found.first + begin)


# -- suffix arrays ------------------------------------------------------------------------------


def _suffix_types(text: np.ndarray) -> np.ndarray:
    """True for suffixes smaller than the next one (S); the last counts as S."""
    n = len(text)
    change = np.flatnonzero(text[:-1] != text[1:])  # ends of runs of one symbol
    if not change.size:
        out = np.zeros(n, bool)
        out[-1] = True
        return out
    of_run = text[change] < text[change + 1]
    run = np.searchsorted(change, np.arange(n))
    return np.r_[of_run, True][run]


def _ranked(keys: np.ndarray) -> np.ndarray:
    """Dense ranks of keys; equal ones share theirs."""
    order = np.argsort(keys)
    k = keys[order]
    step = np.zeros(len(k), np.uint64)
    np.not_equal(k[1:], k[:-1], out=step[1:], casting="unsafe")
    out = np.empty(len(k), np.uint64)
    out[order] = np.cumsum(step)
    return out


def _order_of_names(names: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Order of the suffixes of the string of names, never beyond a segment's end.

    The recursion: names of neighbours are joined and named anew until all differ or segments end.
    """
    step, n = 1, len(names)
    while step < n:
        inside = group[:-step] == group[step:]
        if not inside.any():
            break
        keys = names << np.uint64(32)
        keys[: n - step] |= np.where(inside, names[step:] + np.uint64(1), np.uint64(0))
        names = _ranked(keys)
        if names.max() == n - 1:
            break
        step *= 2
    return np.argsort(names)


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix array of segments of symbols 1..256, each ended by 0, where a suffix ends at its 0.

    Suffixes are classified, the leftmost smaller (LMS) substrings sorted and named, their suffixes
    ordered through the string of names, and all others induced from them: one bucket of a first
    symbol after the other, so that each step places many suffixes at once.
    """
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    small = _suffix_types(text)
    small[text == 0] = True
    is_lms = text == 0
    is_lms[1:] |= small[1:] & ~small[:-1]
    lms = np.flatnonzero(is_lms)
    group = np.cumsum(text[lms] == 0) - (text[lms] == 0)
    # names of the LMS substrings by their symbols up to the next one, 7 to a key; one that ends is
    # larger than one that goes on, as the symbol there is of the smaller type
    size = np.append(np.diff(lms), 0)
    size[text[lms] == 0] = 0
    names = np.zeros(len(lms), np.uint64)
    padded = np.concatenate([text, np.zeros(8, text.dtype)]).astype(np.uint64)
    for w in range(0, int(size.max()) + 1, 7):
        long = np.flatnonzero(size >= w)
        key = np.zeros(len(long), np.uint64)
        for k in range(w, w + 7):
            key = key * np.uint64(258) + np.where(k <= size[long], padded[np.minimum(lms[long] + k, n + 7)], PAST)
        ranks = np.full(len(lms), 0xFFFFFFFF, np.uint64)
        ranks[long] = _ranked(key)
        names = _ranked(names << np.uint64(32) | ranks)
    return _induced(text, small, lms[_order_of_names(names, group)])


def _induced(text: np.ndarray, small: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """All suffixes in order, from the sorted LMS suffixes: larger ones upwards, smaller ones downwards."""

    def scan(seeds: list[np.ndarray], wanted: np.ndarray, symbols: range) -> list[np.ndarray]:
        out: list[list[np.ndarray]] = [[] for _ in range(257)]
        for c in symbols:
            place = 0
            while place <= len(out[c]):  # its own suffixes, among them those that it gains meanwhile; then the seeds
                now = out[c][place] if place < len(out[c]) else seeds[c]
                place += 1
                before = now[now > 0] - 1
                before = before[wanted[before] & (text[before] > 0)]
                if not before.size:
                    continue
                first = text[before]
                order = np.argsort(first, kind="stable")
                first, before = first[order], before[order]
                cut = [0, *(np.flatnonzero(first[1:] != first[:-1]) + 1).tolist(), len(first)]
                for symbol, a, b in zip(first[cut[:-1]].tolist(), cut, cut[1:], strict=False):
                    out[symbol].append(before[a:b])
        return [np.concatenate(x) if x else np.zeros(0, np.int64) for x in out]

    by = [lms[text[lms] == c] for c in range(257)] if len(lms) < 4096 else _split(lms, text[lms])
    large = scan(by, ~small, range(257))
    # downwards every bucket is read from its end: first its smaller suffixes as they come, then its larger ones
    down = [x[::-1] for x in large]
    down[0] = by[0][::-1]
    less = scan(down, small, range(256, -1, -1))
    return np.concatenate([np.concatenate([large[c] if c else by[0], less[c][::-1]]) for c in range(257)])


def _split(items: np.ndarray, symbols: np.ndarray) -> list[np.ndarray]:
    order = np.argsort(symbols, kind="stable")
    cut = np.searchsorted(symbols[order], np.arange(258))
    return [items[order[cut[c] : cut[c + 1]]] for c in range(257)]


def permuted_common_prefixes(data: np.ndarray, left: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """For each position, the bytes it shares with the suffix before it in order, up to ``most``.

    Read in text order, eight bytes at a time. ``left``: bytes to the end of each position's segment.
    """
    n = len(data)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    padded = np.r_[data, np.zeros(most + 16, np.uint8)]
    words = np.empty(n + most + 8, np.uint64)
    for k in range(8):
        part = np.frombuffer(padded[k : k + (len(padded) - k) // 8 * 8].tobytes(), "<u8")
        words[k::8] = part[: len(words[k::8])]
    out = np.zeros(n, np.int64)
    live = np.flatnonzero(before >= 0)
    for k in range(0, most, 8):
        differ = words[live + k] ^ words[before[live] + k]
        same = differ == 0
        low = differ[~same]
        out[live[~same]] += np.log2((low & (~low + np.uint64(1))).astype(float)).astype(np.int64) // 8
        live = live[same]
        out[live] += 8
        if not live.size:
            break
    return np.minimum(np.minimum(out, most), np.minimum(left, np.where(before >= 0, left[before], 0)))


def repeated(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, docs: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Segment number and position of the strings of ``length`` bytes that also start in a segment
    of a smaller document. Segments are spans of data."""
    at = np.concatenate([[0], np.cumsum(sizes + 1)])
    number = np.repeat(np.arange(len(sizes)), sizes + 1)
    offset = np.arange(at[-1]) - at[number]
    left = sizes[number] - offset
    joined = np.where(left > 0, data[np.minimum(starts[number] + offset, max(len(data) - 1, 0))] if len(data) else 0, 0).astype(np.uint8)
    text = joined.astype(np.int16) + 1
    text[at[1:] - 1] = 0
    order = suffix_array(text)
    shared = permuted_common_prefixes(joined, left, order, length)[order] >= length
    runs = np.flatnonzero(~shared)  # suffixes that share ``length`` bytes stand side by side
    doc = docs[number[order]]
    least = np.repeat(np.minimum.reduceat(doc, runs), np.diff(np.append(runs, len(order))))
    hit = order[(doc > least) & (left[order] >= length)]
    return number[hit], offset[hit]


def resolve(h: np.ndarray, doc: np.ndarray, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first and last string of the runs of strings to remove, for runs given with anchor and document.

    All runs of an anchor must be there.
    """
    whole = mix(mix(h) ^ span_hashes(data, starts, starts + sizes, EXACT))
    order = np.argsort(whole)
    cut = np.flatnonzero(np.append(True, whole[order][1:] != whole[order][:-1]))
    low = np.minimum.reduceat(doc[order], cut)
    segment = np.empty(len(order), np.int64)
    segment[order] = np.repeat(np.arange(len(cut)), np.diff(np.append(cut, len(order))))
    one = order[cut]  # a row of each segment
    copies = np.flatnonzero(doc > low[segment])
    of_anchor = np.unique(h[one], return_inverse=True, return_counts=True)
    several = np.flatnonzero(of_anchor[2][of_anchor[1]] > 1)
    rows, first, last = [copies], [np.zeros(len(copies), np.int64)], [sizes[copies] - length]
    if several.size:
        number, place = repeated(data, starts[one[several]], sizes[one[several]], low[several], length)
        number = several[number]
        by = np.lexsort((place, number))
        number, place = number[by], place[by]
        begin = np.flatnonzero(np.append(True, (number[1:] != number[:-1]) | (place[1:] != place[:-1] + 1))) if len(number) else np.zeros(0, np.int64)
        stop = np.append(begin[1:], len(number))[: len(begin)] - 1
        number, a, b = number[begin], place[begin], place[stop]
        # every row of the segment's smallest document
        least = np.flatnonzero(doc == low[segment])
        least = least[np.argsort(segment[least], kind="stable")]
        lo, hi = np.searchsorted(segment[least], number), np.searchsorted(segment[least], number, "right")
        times = hi - lo
        pick = np.repeat(lo - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(times.sum()) if len(times) else lo
        rows.append(least[pick])
        first.append(np.repeat(a, times))
        last.append(np.repeat(b, times))
    return np.concatenate(rows), np.concatenate(first), np.concatenate(last)


# -- the job ------------------------------------------------------------------------------------


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")


def anchor_counts(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """h, n of the anchors in two or more documents; batches send each of their anchors once."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, _, runs in runs_of(batches, length):
            if not runs.hash.size:
                continue
            order = np.argsort(runs.hash)
            h, doc = runs.hash[order], ids[runs.row[order]]
            cut = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
            columns = h[cut].view(np.int64), np.minimum.reduceat(doc, cut), np.maximum.reduceat(doc, cut), np.diff(np.append(cut, len(h)))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["h", "low", "high", "n"])

    found = _texts(docs).where("doc_id is not null").mapInArrow(count, "h long, low long, high long, n long")
    return found.groupBy("h").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n")).where("low < high").select("h", "n")


SPAN = "doc_id long, begin array<long>, end array<long>"


def _by_document(doc: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
    """One row for each document, with its spans; spans that touch are one."""
    order = np.lexsort((begin, doc))
    doc, begin, end = doc[order], begin[order], end[order]
    fresh = np.ones(len(doc), bool)
    if len(doc):
        np.not_equal(doc[1:], doc[:-1], out=fresh[1:])
        fresh[1:] |= begin[1:] > end[:-1]  # two runs of one anchor hardly ever nest; if so, the spans stay apart
    one = np.flatnonzero(fresh)
    end = np.maximum.reduceat(end, one) if one.size else end
    doc, begin = doc[one], begin[one]
    cut = np.flatnonzero(np.append(True, doc[1:] != doc[:-1])) if len(doc) else np.zeros(0, np.int64)
    at = pa.array(np.append(cut, len(doc)).astype(np.int32))
    return pa.RecordBatch.from_arrays([pa.array(doc[cut]), *(pa.ListArray.from_arrays(at, pa.array(x)) for x in (begin, end))], names=["doc_id", "begin", "end"])


def _member(sorted_: np.ndarray, keys: np.ndarray) -> np.ndarray:
    if not sorted_.size:
        return np.zeros(len(keys), bool)
    return sorted_[np.searchsorted(sorted_, keys).clip(max=len(sorted_) - 1)] == keys


def spans(docs: DataFrame, length: int = LENGTH, hot_rows: int = HOT_ROWS) -> DataFrame:
    """doc_id, begin, end: lists of spans that cover every string that also starts in a smaller document."""
    counts = written(anchor_counts(docs, length), "suffix-anchors")
    total = counts.agg(F.sum("n")).first()[0] or 0
    most = max(hot_rows, -(-total // MAX_HOT))
    hot = np.sort(counts.where(F.col("n") > most).select("h").toArrow()["h"].to_numpy().astype(np.int64).view(np.uint64))
    told = docs.sparkSession.sparkContext.broadcast((bitmap(counts, "h", ANCHOR_BITS), hot))
    texts = _texts(docs).where("doc_id is not null")

    def give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, hot = told.value
        for ids, data, runs in runs_of(batches, length):
            keep = np.flatnonzero(in_bitmap(bits, runs.hash) & ~_member(hot, runs.hash))
            columns = [pa.array(x) for x in (ids[runs.row[keep]], runs.first[keep], runs.hash[keep].view(np.int64))]
            yield pa.RecordBatch.from_arrays([*columns, gathered(data, runs.place[keep], runs.count[keep] + length - 1)], names=["doc_id", "at", "h", "bytes"])

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(table: pa.Table) -> pa.RecordBatch:
            h, doc, at = (table[x].to_numpy().astype(np.int64) for x in ("h", "doc_id", "at"))
            column = table["bytes"].combine_chunks().cast(pa.large_binary())
            column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
            offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
            data = np.frombuffer(column.buffers()[2], np.uint8)[: offsets[-1]]
            row, first, last = resolve(h.view(np.uint64), doc, data, offsets[:-1], np.diff(offsets), length)
            return _by_document(doc[row], at[row] + first, at[row] + last + length)

        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if batch.num_rows and size >= SHARD_BYTES:  # rows come by hash: no anchor is divided
                h = batch.column(2).to_numpy()
                other = np.flatnonzero(h != held[-1].column(2)[-1].as_py())
                if other.size:
                    yield done(pa.Table.from_batches([*held, batch.slice(0, other[0])]))
                    held, size, batch = [], 0, batch.slice(other[0])
            if batch.num_rows:
                held.append(batch)
                size += batch.nbytes
        if held:
            yield done(pa.Table.from_batches(held))

    parts = texts.mapInArrow(give, "doc_id long, at long, h long, bytes binary").repartition("h").sortWithinPartitions("h")
    found = parts.mapInArrow(shard, SPAN)
    return found.unionByName(_hot_spans(texts, told, length)) if hot.size else found


def _hot_spans(texts: DataFrame, told, length: int) -> DataFrame:
    """Spans of the hot anchors.

    Equal runs are one context; a batch of texts tells each of its contexts once, with the hashes of
    its strings, and each place of a context once for a document. Strings get their smallest document,
    contexts theirs back, and documents their contexts'.
    """
    schema = "c long, doc_id long, at array<long>, strings array<long>"

    def give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, many = told.value[1], pa.list_(pa.int64())
        for ids, data, runs in runs_of(batches, length):
            keep = np.flatnonzero(_member(hot, runs.hash))
            if not keep.size:
                continue
            place, count = runs.place[keep], runs.count[keep]
            c = mix(runs.hash[keep] ^ span_hashes(data, place, place + count + length - 1, EXACT)).view(np.int64)
            doc, at = ids[runs.row[keep]], runs.first[keep]
            order = np.lexsort((at, doc, c))
            c, doc, at, place, count = c[order], doc[order], at[order], place[order], count[order]
            new = np.append(True, c[1:] != c[:-1])
            both = np.flatnonzero(new | np.append(True, doc[1:] != doc[:-1]))
            strings = rolling(data, length).view(np.int64)
            told_ = [strings[p : p + n] if x else None for x, p, n in zip(new[both], place[both], count[both], strict=True)]
            ends = pa.array(np.append(both, len(c)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(c[both]), pa.array(doc[both]), pa.ListArray.from_arrays(ends, pa.array(at)), pa.array(told_, many)], names=["c", "doc_id", "at", "strings"])

    told_ = written(texts.mapInArrow(give, schema), "suffix-hot")
    # of a batch, the row with the strings has the context's smallest document
    contexts = told_.where("strings is not null").groupBy("c").agg(F.min("doc_id").alias("low"), F.first("strings").alias("strings"))
    each = written(contexts.select("c", "low", F.posexplode("strings").alias("k", "s")), "suffix-hot-strings")
    least = each.groupBy("s").agg(F.min("low").alias("least"), F.count("*").alias("n")).where("n > 1").select("s", "least")
    lows = each.join(least, "s").where("least < low").groupBy("c").agg(F.collect_list(F.struct("k", "least")).alias("lows"))  # as many as a run has strings
    known = each.groupBy("c").agg(F.min("low").alias("low"), F.count("*").alias("count")).join(lows, "c", "left")
    rows = told_.select("c", "doc_id", "at").join(known, "c")
    is_whole = F.col("doc_id") > F.col("low")
    begin = F.when(is_whole, F.col("at")).otherwise(F.flatten(F.transform("at", lambda a: F.transform("lows", lambda x: a + x["k"]))))
    size = F.when(is_whole, F.col("count") + length - 1).otherwise(length)
    found = rows.where(is_whole | F.col("lows").isNotNull())
    return found.select("doc_id", begin.alias("begin"), F.transform(begin, lambda x: x + size).alias("end"))


def _merged(begin: list[int], end: list[int]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(zip(begin, end, strict=True)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _whole(piece: bytes, after_cut: bool, before_cut: bool) -> bytes:
    """A piece of UTF-8 without the parts of characters that a cut left at its edges."""
    a, b = 0, len(piece)
    while after_cut and a < b and piece[a] & 0xC0 == 0x80:
        a += 1
    if before_cut:
        lead = b - 1
        while lead > max(a, b - 4) and piece[lead] & 0xC0 == 0x80:
            lead -= 1
        if lead >= a and b - lead < (piece[lead] >= 0xC0) + (piece[lead] >= 0xE0) + (piece[lead] >= 0xF0) + 1:
            b = lead
    return piece[a:b]


def remove_repeats(docs: DataFrame, length: int = LENGTH, hot_rows: int = HOT_ROWS, with_text: bool = False, prefix: str = "") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document, after taking out each byte
    that a string of ``length`` bytes covers which also starts in a document with a smaller doc_id.

    ``with_text`` adds ``kept``, the text that stays, and keeps docs' other columns, but for those of the
    result's names. Of a character that a cut parts, ``kept`` has nothing, while the counts and the digest are of
    all bytes that stay. ``prefix`` goes before all of these names but doc_id. A null text is
    empty, matches never cross documents, strings are judged on the input. Rows without a doc_id take no part and
    lose nothing; rows that repeat a doc_id are one document: none loses bytes to the other, each
    loses those at the places found in any. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    found = written(spans(docs, length, hot_rows), "suffix-spans")
    told = spark.sparkContext.broadcast(bitmap(found, "doc_id", DOC_BITS))
    kinds_ = {"n_bytes": "long", "n_removed": "long", "n_spans": "long", "kept_sha256": "string"} | ({"kept": "string"} if with_text else {})
    result = ", ".join(["doc_id long", *(f"{prefix}{n} {k}" for n, k in kinds_.items())])
    names = [x.split()[0] for x in result.split(", ")]
    rest = [c for c in docs.columns if c not in ("text", *names)] if with_text else []
    fields = [docs.schema[c] for c in rest]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, at in text_batches(batches):
            raw = data.tobytes()
            rows: list[tuple] = []
            texts_: list[bytes] = []
            lists = batch.column(batch.schema.get_field_index("spans")).to_pylist() if "spans" in batch.schema.names else [None] * batch.num_rows
            for k, (doc, found_) in enumerate(zip(batch.column(0).to_pylist(), lists, strict=True)):
                text = raw[at[k] : at[k + 1]]
                pairs = _merged(found_["begin"], [min(x, len(text)) for x in found_["end"]]) if found_ else []
                pairs = [(a, b) for a, b in pairs if a < b]
                edges = [0, *(x for p in pairs for x in p), len(text)]
                parts = [text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)]
                kept = b"".join(parts)
                rows.append((doc, len(text), len(text) - len(kept), len(pairs), hashlib.sha256(kept).hexdigest()))
                if with_text:
                    texts_.append(b"".join(_whole(x, i > 0, i < len(pairs)) for i, x in enumerate(parts)) if pairs else text)
            kinds = [pa.int64()] * 4 + [pa.string()]
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
            if with_text:
                columns.append(pa.array(texts_, pa.binary()).view(pa.string()))  # bytes of uncut texts as they are
            yield pa.RecordBatch.from_arrays([*columns, *(batch.column(batch.schema.get_field_index(c)) for c in rest)], names=[*names, *rest])

    schema = spark.createDataFrame([], result).schema
    for f in fields:
        schema = schema.add(f.name, f.dataType, True)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *rest)

    def sure(batches: Iterator[pa.RecordBatch], hit: bool) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            keys = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            mask = in_bitmap(told.value, keys) & ids.is_valid().to_numpy(zero_copy_only=False)
            yield batch.filter(pa.array(mask if hit else ~mask))

    untouched = texts.mapInArrow(lambda b: cut(sure(b, False)), schema)
    flat = F.struct(*(F.flatten(F.collect_list(c)).alias(c) for c in ("begin", "end")))  # as long as a document has spans
    lists = found.groupBy("doc_id").agg(flat.alias("spans"))
    touched = texts.mapInArrow(lambda b: sure(b, True), texts.schema).join(lists, "doc_id", "left")
    return untouched.unionByName(touched.select(*texts.columns, "spans").mapInArrow(cut, schema))
