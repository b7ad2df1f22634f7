"""Quality rules: counts of every document, and its divergence from its language's references.

A language's references are two histograms over all its documents: of character classes, and of
its most common words. Documents long enough are compared with them by the Jensen-Shannon
distance (base 2, from 0 to 1); shorter ones, and those that name no language, are judged by the counts alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bytescan import EXACT, IS_SPACE, mix, span_hashes, text_batches, windows, word_bounds
from .storage import written

#: A language's most frequent words that its word histogram tells apart; all others are one class.
COMMON = 64
MIN_WORDS = 50
#: Guards and limits of the two distances, set on the labelled rows of a small table (labelled good: at
#: most 0.18 and 0.36; bad, where the counts do not tell: from 0.12 and 0.37 up to 0.85 and 0.93).
GUARD_WORDS = 100
MAX_CLASS = 0.25
MAX_WORDS = 0.5
#: A language with one in MAX_LANGS of all words and documents or more has its reference broadcast, so
#: there are at most MAX_LANGS of them; the others' are joined to their texts, of which no language has many.
MAX_LANGS = 1000
#: Columns of a reference that is joined to its texts.
JOINED = ["__classes", "__hashes", "__counts", "__words"]
SYMBOLS = b"#*$%&|<>"

CLASSES = ["lower", "upper", "digit", "space", "line", "stop", "symbol", "other", "beyond"]
_of_byte = np.full(256, 7, np.int64)
for _k, _set in enumerate((range(97, 123), range(65, 91), range(48, 58), (9, 11, 12, 13, 32), (10,), b".,;:!?'\"()-", SYMBOLS)):
    _of_byte[list(_set)] = _k
_of_byte[128:192] = -1  # the rest of a character
_of_byte[192:] = 8
IS_SYMBOL = np.zeros(256, bool)
IS_SYMBOL[list(SYMBOLS)] = True


def class_counts(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Character classes of each text."""
    kind = _of_byte[data]
    real = kind >= 0
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    n = len(CLASSES)
    return np.bincount(row[real] * n + kind[real], minlength=n * (len(at) - 1)).reshape(-1, n)


def references(docs: DataFrame) -> DataFrame:
    """lang, words, docs, classes (counts), hashes and counts of the common words: a row of fixed size for each language.

    Words go by 64-bit hashes of their bytes. Each task adds up its own counts first, then they are added
    by language and word, and each language's largest remain. Texts without a language make no reference.
    """
    n = len(CLASSES) + 1  # and documents

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Counts of class or word (h) of a language; ``is_class`` tells which."""
        for batch, data, at in text_batches(batches):
            starts, ends, rows = word_bounds(data, at)
            classes, hashes = class_counts(data, at), span_hashes(data, starts, ends, EXACT)
            langs, of = np.unique(np.array(batch.column(1).to_pylist(), object).astype(str), return_inverse=True)
            for k, lang in enumerate(langs):
                words, counts = np.unique(hashes[of[rows] == k], return_counts=True)
                h = np.concatenate([np.arange(n), words.view(np.int64)])
                c = np.concatenate([classes[of == k].sum(axis=0), [np.count_nonzero(of == k)], counts])
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(h)), pa.array(np.arange(len(h)) < n), pa.array(h), pa.array(c.astype(np.int64))], names=["lang", "is_class", "h", "c"])

    texts = docs.select("text", _language().alias("lang")).where("lang is not null")
    sums = texts.mapInArrow(add, "lang string, is_class boolean, h long, c long").groupBy("lang", "is_class", "h").agg(F.sum("c").alias("c"))
    sums = written(sums, "quality-counts")
    of_class = lambda k: F.coalesce(F.sum(F.when(F.col("is_class") & (F.col("h") == k), F.col("c"))), F.lit(0))
    total = sums.groupBy("lang").agg(
        F.coalesce(F.sum(F.when(~F.col("is_class"), F.col("c"))), F.lit(0)).alias("words"), of_class(n - 1).alias("docs"), F.array(*map(of_class, range(n - 1))).alias("classes")
    )
    order = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("c"), "h"))  # limited before the shuffle
    top = sums.where("not is_class").withColumn("k", order).where(F.col("k") <= COMMON)
    top = top.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("k", "h", "c"))).alias("top"))
    none = F.array().cast("array<long>")
    return total.join(top, "lang", "left").select("lang", "words", "docs", "classes", F.coalesce("top.h", none).alias("hashes"), F.coalesce("top.c", none).alias("counts"))


def _language() -> Column:
    """The language of a row; null if it names none."""
    return F.nullif(F.trim(F.col("lang").cast("string")), F.lit(""))


def _shares(classes: list[int], hashes: list[int], counts: list[int], words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class shares, hashes of the common words, and their shares (the last: of all other words)."""
    told, common = np.array(classes, np.int64), np.zeros(COMMON + 1)
    common[: len(counts)] = counts
    common[-1] = words - sum(counts)
    return told / max(told.sum(), 1), np.array(hashes, np.int64).view(np.uint64), common / max(words, 1)


def _places(hashes: np.ndarray, known: np.ndarray) -> np.ndarray:
    """The place of each hash in known; COMMON if it is not there."""
    if not known.size:
        return np.full(len(hashes), COMMON)
    order = np.argsort(known)
    at = np.minimum(np.searchsorted(known[order], hashes), len(known) - 1)
    return np.where(known[order][at] == hashes, order[at], COMMON)


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of the rows of p from q."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        a = np.where(p > 0, p * np.log2(p / m), 0).sum(axis=-1)
        b = np.where(q > 0, q * np.log2(q / m), 0).sum(axis=-1)
    return np.sqrt(np.clip((a + b) / 2, 0, 1))


def counts_of(data: np.ndarray, at: np.ndarray, starts: np.ndarray, ends: np.ndarray, rows: np.ndarray, hashes: np.ndarray) -> list[np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each text."""
    m = len(at) - 1
    row = np.repeat(np.arange(m), np.diff(at))
    is_char = ((data & 0xC0) != 0x80) & ~IS_SPACE[data]
    # lines with a word, by the hash of their whole bytes
    breaks = np.flatnonzero(data == 10)
    begin = np.unique(np.concatenate([at[:-1], breaks + 1]))
    begin = begin[begin < len(data)]
    line_row = np.searchsorted(at, begin, "right") - 1
    stop = np.minimum(np.append(breaks, len(data))[np.searchsorted(breaks, begin)], at[line_row + 1])
    full = np.searchsorted(starts, stop) > np.searchsorted(starts, begin)
    begin, stop, line_row = begin[full], stop[full], line_row[full]
    line = mix(span_hashes(data, begin, stop, EXACT) + line_row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, one = np.unique(line, return_index=True)
    dup = np.bincount(line_row, minlength=m) - np.bincount(line_row[one], minlength=m)
    # words in windows of three found twice or more
    three, first = windows(hashes, rows, 3)
    own = mix(three + rows[first].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, of, times = np.unique(own, return_inverse=True, return_counts=True)
    again = np.zeros(len(starts) + 1, bool)
    hit = first[times[of] > 1]
    for k in range(3):
        again[hit + k] = True
    return [
        np.bincount(rows, minlength=m),
        np.bincount(row[is_char], minlength=m),
        np.bincount(row[IS_SYMBOL[data]], minlength=m),
        dup,
        np.bincount(rows[again[:-1]], minlength=m),
    ]


def quality(docs: DataFrame, carry: bool = False, prefix: str = "") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, class_distance, word_distance.

    ``base_failed``: fewer than 50 words, or more than half of them in repeated windows. ``kept``: not
    that, and, from GUARD_WORDS words on, both distances within their limits. Null and empty texts
    have no words and fail. Each language, however rare, is compared with its own references; rows
    without a language (null or blank) have null distances. Repeated rows are judged each.
    ``carry`` keeps docs' other columns and text, for filtering without a join, but for those of the
    result's names; ``prefix`` goes before these names. Two scans; only texts of rare languages are shuffled.
    """
    spark = docs.sparkSession
    refs = written(references(docs), "quality-references")
    weight = F.col("words") + F.col("docs")
    total = refs.agg(F.sum(weight)).first()[0] or 0
    is_large = weight * MAX_LANGS >= total
    large = {r["lang"]: _shares(r["classes"], r["hashes"], r["counts"], r["words"]) for r in refs.where(is_large).collect()}
    told = spark.sparkContext.broadcast(large)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "class_distance", "word_distance"]
    names = [prefix + n for n in names]
    kinds = ["long"] * 5 + ["boolean"] * 2 + ["double"] * 2

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = COMMON + 1
        for batch, data, at in text_batches(batches):
            starts, ends, rows = word_bounds(data, at)
            hashes = span_hashes(data, starts, ends, EXACT)
            counts = counts_of(data, at, starts, ends, rows, hashes)
            n, repeats = counts[0], counts[4]
            classes = class_counts(data, at)
            column = {c: batch.column(i) for i, c in enumerate(batch.schema.names)}
            langs = column["__lang"].to_pylist()
            first = {lang: k for k, lang in reversed(list(enumerate(langs))) if lang is not None}
            number = {lang: k for k, lang in enumerate(first)}
            of = np.array([number.get(lang, len(first)) for lang in langs], np.int64)
            # the last is for rows without a language
            shares, common = np.zeros((len(first) + 1, len(CLASSES))), np.zeros((len(first) + 1, width))
            place = np.full(len(hashes), COMMON)
            for lang, k in number.items():
                ref = _shares(*(column[c][first[lang]].as_py() for c in JOINED)) if JOINED[0] in column else told.value[lang]
                shares[k], common[k] = ref[0], ref[2]
                own = of[rows] == k
                place[own] = _places(hashes[own], ref[1])
            words = np.bincount(rows * width + place, minlength=width * len(n)).reshape(-1, width)
            far = [
                distance(classes / np.maximum(classes.sum(axis=1, keepdims=True), 1), shares[of]),
                distance(words / np.maximum(words.sum(axis=1, keepdims=True), 1), common[of]),
            ]
            none = of == len(first)
            failed = (n < MIN_WORDS) | (100 * repeats > 50 * n)
            kept = ~failed & (none | (n < GUARD_WORDS) | ((far[0] <= MAX_CLASS) & (far[1] <= MAX_WORDS)))
            out = [*map(pa.array, (*counts, failed, kept)), *(pa.array(x, mask=none) for x in far)]
            yield pa.RecordBatch.from_arrays([*(column[c] for c in fields), *out], names=[*fields, *names])

    rest = [c for c in docs.columns if c not in names] if carry else ["doc_id", "text"]
    frame = docs.select(*rest, _language().alias("__lang"))
    fields = rest if carry else ["doc_id"]
    schema = docs.select(*fields).schema
    for name, kind in zip(names, kinds, strict=True):
        schema = schema.add(name, kind)
    rare = refs.where(~is_large)
    if rare.isEmpty():
        return frame.mapInArrow(judge, schema)
    told_here = F.col("__lang").isNull() | F.col("__lang").isin(list(large))
    joined = frame.where(~told_here).join(rare.select(F.col("lang").alias("__lang"), *(F.col(c[2:]).alias(c) for c in JOINED)), "__lang")
    return frame.where(told_here).mapInArrow(judge, schema).unionByName(joined.select(*frame.columns, *JOINED).mapInArrow(judge, schema))
