"""Language-model scores: the marginal probability of a text over all its segmentations.

Pieces come from an existing subword vocabulary; their unigram scores start from its own ranks
and are fitted to the training documents by expectation maximisation. No piece crosses white space,
so a text's probability is the product of its words' and an end's, and a word's is summed over all
ways to segment it by a forward recursion in log space, many words at a time. A word that training
has seen is one more edge over its whole lattice, weighing as often as it was seen; all other edges
share the mass that training leaves to words it has not seen (by Good and Turing's estimate).

Beside it stands the smoothed word unigram. Words that hold a share of at least one in HEAVY of all
training tokens are at most HEAVY and are broadcast; the others are joined.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytescan import EXACT, FOLDED, LOWER, P, P_INV, gathered, mix, power_at, span_hashes, text_batches, word_bounds
from .storage import written

HEAVY = 1 << 20
ROUNDS = 2
FLOOR = 0.01
BATCH = 4 << 20
LONG_WORD = 256
LN10 = math.log(10)


# -- vocabulary ---------------------------------------------------------------------------------


def vocabulary(model_path: str) -> tuple[list[bytes], np.ndarray]:
    """Pieces that can stand in a word after one space, and weights from the ranks the file gives them.

    Single bytes are always among them, so every text has a segmentation.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    pieces: dict[bytes, float] = {bytes([b]): 0.0 for b in range(256)}
    for i in range(model.get_piece_size()):
        if model.is_control(i) or model.is_unknown(i) or model.is_byte(i):
            continue
        piece = model.id_to_piece(i).replace("▁", " ").encode()
        if piece and b" " not in piece[1:]:
            pieces[piece] = 1.0 / (2.0 - model.get_score(i))
    weights = np.array(list(pieces.values()))
    weights[weights == 0] = weights[weights > 0].min()
    return list(pieces), weights


class Lattice:
    """Segmentation sums of many words at once."""

    def __init__(self, pieces: list[bytes], logs: np.ndarray) -> None:
        data = np.frombuffer(b"".join(pieces), np.uint8)
        sizes = np.array([len(p) for p in pieces])
        ends = np.cumsum(sizes)
        keys = span_hashes(data, ends - sizes, ends, EXACT)
        self.logs, self.longest = logs, int(sizes.max())
        self.tables: list[tuple[np.ndarray, np.ndarray]] = []
        rest = np.arange(len(keys))
        while rest.size:  # a key that finds its slot taken goes to the next table
            slot = self._slots(keys[rest], len(self.tables))
            held, number = np.zeros(1 << 18, np.uint64), np.full(1 << 18, -1, np.int32)
            number[slot] = rest
            held[slot] = keys[rest]
            self.tables.append((held, number))
            rest = rest[number[slot] != rest]

    @staticmethod
    def _slots(keys: np.ndarray, table: int) -> np.ndarray:
        return (keys >> np.uint64(46 - 11 * min(table, 4))).astype(np.int64) & ((1 << 18) - 1)

    def _numbers(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int32)
        for k, (held, number) in enumerate(self.tables):
            slot = self._slots(keys, k)
            found = held[slot] == keys
            out[found] = number[slot[found]]
        return out

    def edges(self, data: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
        """For each length, the number of the piece that starts at each byte of the words, else -1."""
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(EXACT[data] * power_at(P, np.arange(len(data))), out=total[1:])
        place = np.arange(len(data))
        room = np.repeat(at[1:], np.diff(at)) - place
        scale = power_at(P_INV, place)
        out = []
        for size in range(1, self.longest + 1):
            start = np.flatnonzero(room >= size)
            number = np.full(len(data), -1, np.int32)
            if start.size:
                number[start] = self._numbers(mix((total[start + size] - total[start]) * scale[start] + np.uint64(size)))
            out.append(number)
        return out

    def _sums(self, begin: np.ndarray, size: int, edges: list[np.ndarray], logs: np.ndarray, backward: bool) -> np.ndarray:
        """Log sums over the segmentations of each prefix (or suffix) of words of one size."""
        if size > LONG_WORD:
            return np.stack([self._long_sums(b, size, edges, logs, backward) for b in begin.tolist()], axis=1)
        sums = np.full((size + 1, len(begin)), -np.inf)
        sums[size if backward else 0] = 0
        for j in range(size - 1, -1, -1) if backward else range(1, size + 1):
            lengths = range(1, min(self.longest, (size - j) if backward else j) + 1)
            terms = np.empty((len(lengths), len(begin)))
            for k, n in enumerate(lengths):
                start, other = (j, j + n) if backward else (j - n, j - n)
                terms[k] = sums[other] + logs[edges[n - 1][begin + start]]
            top = terms.max(axis=0)
            sums[j] = top + np.log(np.exp(terms - top).sum(axis=0))
        return sums

    def _long_sums(self, begin: int, size: int, edges: list[np.ndarray], logs: np.ndarray, backward: bool) -> np.ndarray:
        """The same for one long word: its pieces are looked up at once, only the recursion walks."""
        steps = np.stack([logs[e[begin : begin + size]] for e in edges])  # [length - 1, start]
        if backward:
            steps = steps[:, ::-1]
        else:  # by the place where a piece ends, to walk both ways alike
            steps = np.stack([np.concatenate([np.full(n, -np.inf), row[: size - n]]) for n, row in enumerate(steps)])
        sums = np.full(size + self.longest + 1, -np.inf)
        sums[self.longest] = 0  # the places before the first
        rows = np.ascontiguousarray(steps.T)
        for j in range(size):
            terms = rows[j] + sums[j + 1 : j + 1 + self.longest][::-1]
            top = terms.max()
            sums[self.longest + j + 1] = top + np.log(np.exp(terms - top).sum())
        out = sums[self.longest :]
        return out[::-1] if backward else out

    def _groups(self, at: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        sizes = np.diff(at)
        order = np.argsort(sizes, kind="stable")
        cut = np.flatnonzero(np.append(True, sizes[order][1:] != sizes[order][:-1])) if len(order) else []
        for a, b in zip(cut, [*cut[1:], len(order)], strict=False):  # no words, no groups
            for k in range(a, b, 1 << 14):
                yield int(sizes[order[a]]), order[k : min(b, k + (1 << 14))]

    def log_marginals(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Natural logs of the words' probabilities."""
        edges, logs = self.edges(data, at), np.append(self.logs, -np.inf)
        out = np.zeros(len(at) - 1)
        for size, words in self._groups(at):
            out[words] = self._sums(at[words], size, edges, logs, False)[size]
        return out

    def expected(self, data: np.ndarray, at: np.ndarray, counts: np.ndarray, fresh: float = 1.0, total: int = 0) -> np.ndarray:
        """Expected number of each piece in the words, each counted so often.

        With ``total``, a word of count c counts as far as its pieces, of mass ``fresh``, are likelier its
        source than the other c - 1 of total tokens.
        """
        edges, logs = self.edges(data, at), np.append(self.logs, -np.inf)
        out = np.zeros(len(self.logs) + 1)
        for size, words in self._groups(at):
            begin = at[words]
            ahead = self._sums(begin, size, edges, logs, False)
            behind = self._sums(begin, size, edges, logs, True)
            if total:
                mine, c = fresh * np.exp(ahead[size]), counts[words]
                counts = counts.astype(float)
                counts[words] = c * np.where(c > 1, mine / np.maximum(mine + (1 - fresh) * (c - 1) / total, 1e-300), 1.0)
            if size > LONG_WORD:
                for k, b in enumerate(begin.tolist()):
                    for n in range(1, min(self.longest, size) + 1):
                        number = edges[n - 1][b : b + size - n + 1]
                        share = np.exp(ahead[: size - n + 1, k] + logs[number] + behind[n:, k] - ahead[size, k])
                        out += np.bincount(np.where(number >= 0, number, len(self.logs)), share * counts[words[k]], len(out))
                continue
            for j in range(size):
                for n in range(1, min(self.longest, size - j) + 1):
                    number = edges[n - 1][begin + j]
                    real = np.flatnonzero(number >= 0)
                    if real.size:
                        share = np.exp(ahead[j, real] + logs[number[real]] + behind[j + n, real] - ahead[size, real])
                        out += np.bincount(number[real], share * counts[words[real]], len(out))
        return out[:-1]


def _spaced(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words, each after one space, as bytes and offsets."""
    at = np.concatenate([[0], np.cumsum(sizes + 1)])
    out = np.full(at[-1], 32, np.uint8)
    index = np.repeat(starts - (at[:-1] + 1), sizes)
    place = np.arange(at[-1])
    inside = np.ones(at[-1], bool)
    inside[at[:-1]] = False
    out[inside] = data[index + place[inside]]
    return out, at


# -- jobs ---------------------------------------------------------------------------------------


def held_out(doc_id: str = "doc_id"):
    """Whether crc32(doc_id as text) mod 5 is 1; without a doc_id a row is held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(5)) == 1, F.lit(True))


def word_counts(docs: DataFrame) -> DataFrame:
    """h, word, c of all words of docs, A-Z lower-cased; batches are counted before they are sent."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, data, at in text_batches(batches, most=BATCH):
            starts, ends, _ = word_bounds(data, at)
            h, one, c = np.unique(span_hashes(data, starts, ends, FOLDED), return_index=True, return_counts=True)
            words = gathered(LOWER[data], starts[one], ends[one] - starts[one])
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), words, pa.array(c)], names=["h", "word", "c"])

    return docs.select("text").mapInArrow(count, "h long, word binary, c long").groupBy("h", "word").agg(F.sum("c").alias("c"))


def fit(counts: DataFrame, pieces: list[bytes], weights: np.ndarray, fresh: float, n: int, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """Natural-log probabilities of the pieces and of the end.

    Each round sums expected piece counts over the distinct words; as many rows come to the driver
    as the vocabulary has pieces.
    """
    spark = counts.sparkSession

    def logs_of(w: np.ndarray) -> tuple[np.ndarray, float]:
        return np.log(w / (w.sum() + 1)), -math.log(w.sum() + 1)  # the end counts once

    # before the first round an end is as likely as a piece
    logs, end = np.log(weights / (2 * weights.sum())), math.log(0.5)
    for _ in range(rounds):
        told = spark.sparkContext.broadcast((pieces, logs))

        def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lattice, total = Lattice(*told.value), np.zeros(len(told.value[0]))  # noqa: B023
            for batch in batches:
                column = batch.column(0).cast(pa.large_binary())
                at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
                data = np.frombuffer(column.buffers()[2], np.uint8) if len(column) else np.zeros(0, np.uint8)
                words, place = _spaced(data, at[:-1], np.diff(at))
                total += lattice.expected(words, place, batch.column(1).to_numpy(), fresh, n)
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["piece", "e"])

        sums = counts.select("word", "c").mapInArrow(expect, "piece long, e double").groupBy("piece").agg(F.sum("e").alias("e")).toArrow()
        expected = np.full(len(pieces), FLOOR)
        expected[sums["piece"].to_numpy()] += sums["e"].to_numpy()
        logs, end = logs_of(expected)
        told.unpersist()
    return logs, end


def lm_scores(docs: DataFrame, model_path: str | None, rounds: int = ROUNDS, heavy: int = HEAVY) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document.

    Tokens are the words and one end; null and empty texts have the end alone. ``score`` is the
    log10 of the text's marginal probability, words taken as separated by one space. Without
    training documents base scores are 0 and pieces keep the weights of their ranks. Repeated rows are
    scored each, and count in training each. Other columns are not carried. Without a model the columns but ``score`` are
    made, as they need no pieces.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out().alias("held_out"))
    train = texts.where("not held_out")
    counts = written(word_counts(train), "lm-counts")
    n_ends = train.select("doc_id").count()
    found = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v"), F.count(F.when(F.col("c") == 1, 1)).alias("once")).first()
    n, v = found["n"] + n_ends, found["v"] + (n_ends > 0)
    pieces, logs, seen, unseen, end = [], None, 0.0, 0.0, 0.0
    if model_path is not None:
        pieces, weights = vocabulary(model_path)
        fresh = (found["once"] + 1) / (n + 2)
        logs, end = fit(counts, pieces, weights, fresh, n, rounds)
        seen, unseen = (1 - fresh) / max(n, 1), math.log10(fresh)
        end = math.log10(seen * n_ends + fresh * math.exp(end))
    least = -(-n // heavy)
    table = counts.where(F.col("c") >= max(least, 1)).select("h", "c").toArrow()  # at most ``heavy`` rows
    keys, c = table["h"].to_numpy().astype(np.int64).view(np.uint64), table["c"].to_numpy().astype(np.int64)
    order = np.argsort(keys)
    told = spark.sparkContext.broadcast((pieces, logs, keys[order], c[order]))
    lists = ["h", "n"] if model_path is None else ["h", "n", "own"]
    schema = "uid long, doc_id long, held_out boolean, n_tokens long, known long, base double, h array<long>, n array<int>" + ("" if model_path is None else ", score double, own array<double>")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pieces, logs, keys, c = told.value
        lattice, uid = Lattice(pieces, logs) if pieces else None, TaskContext.get().partitionId() << 40
        value = np.log10(c + 0.5)
        for batch, data, at in text_batches(batches, most=BATCH):
            starts, ends, rows = word_bounds(data, at)
            h, one, of = np.unique(span_hashes(data, starts, ends, FOLDED), return_index=True, return_inverse=True)
            m = len(at) - 1
            at_key = np.searchsorted(keys, h).clip(max=max(len(keys) - 1, 0))
            is_heavy = keys[at_key] == h if len(keys) else np.zeros(len(h), bool)
            worth = np.where(is_heavy, value[at_key] if len(keys) else 0.0, math.log10(0.5))
            n_words = np.bincount(rows, minlength=m)
            # the other words of each document, with their numbers
            rest = np.flatnonzero(~is_heavy[of])
            pair = rows[rest] * np.int64(len(h)) + of[rest]
            pair, times = np.unique(pair, return_counts=True)
            row, word = pair // max(len(h), 1), pair % max(len(h), 1)
            cut = np.searchsorted(row, np.arange(m + 1)).astype(np.int32)
            each = lambda x, kind: pa.ListArray.from_arrays(pa.array(cut), pa.array(x, kind))  # noqa: B023, E731
            columns = [
                pa.array(np.arange(uid, uid + m)),
                batch.column(0),
                batch.column(2),
                pa.array(n_words + 1),
                pa.array(np.bincount(rows, is_heavy[of], m).astype(np.int64) + (n_ends > 0)),
                pa.array(np.bincount(rows, worth[of], m) + math.log10(n_ends + 0.5)),
                each(h[word].view(np.int64), pa.int64()),
                each(times, pa.int32()),
            ]
            if lattice:
                words, place = _spaced(LOWER[data], starts[one], ends[one] - starts[one])
                own = unseen + lattice.log_marginals(words, place) / LN10
                marginal = np.where(is_heavy, np.log10(seen * (c[at_key] if len(keys) else 0.0) + 10.0**own), own)
                columns += [pa.array(np.bincount(rows, marginal[of], m) + end), each(own[word], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in schema.split(", ")])
            uid += m

    scored = written(texts.mapInArrow(score, schema), "lm-scored")
    rest = scored.select("uid", F.explode(F.arrays_zip(*lists)).alias("x")).select("uid", "x.*")
    light = counts.where(F.col("c") < max(least, 1)).select("h", "c")
    sums = {"more": F.col("n") * (F.log10(F.col("c") + 0.5) - F.log10(F.lit(0.5))), "more_known": F.col("n")}
    if model_path is not None:
        sums["more_score"] = F.col("n") * (F.log10(seen * F.col("c") + F.pow(F.lit(10.0), F.col("own"))) - F.col("own"))
    more = rest.join(light, "h").groupBy("uid").agg(*(F.sum(x).alias(name) for name, x in sums.items()))
    whole = F.log10(F.lit(n + 0.5 * (v + 1)))
    return (
        scored.drop(*lists)
        .join(more, "uid", "left")
        .select(
            "doc_id",
            "held_out",
            "n_tokens",
            (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
            F.lit(n).cast("long").alias("train_tokens"),
            (F.col("base") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * whole).alias("base_score"),
            *([] if model_path is None else [(F.col("score") + F.coalesce("more_score", F.lit(0.0))).alias("score")]),
        )
    )
