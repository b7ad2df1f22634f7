"""Token counts of whole texts, encoded in batches by an installed subword library.

Only lengths leave the Arrow function. Batches hold about the same number of bytes, and a long
text is cut at boundaries that no piece of the vocabulary can cross, so counts add up exactly.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

BATCH_BYTES = 1 << 20
LONG_CHARS = 1 << 15
MARK = "▁"
#: One space between characters that are neither spaces nor the mark that stands for one.
SAFE = re.compile(rf"(?<=[^\s{MARK}]) (?=[^\s{MARK}])")


def _splits_safely(model) -> bool:
    """Whether the mark stands at piece starts only and the normaliser leaves text alone."""
    probe = "ﬁ Å x y z Ⅳ"
    if any(MARK in model.id_to_piece(i).lstrip(MARK) for i in range(model.get_piece_size())):
        return False
    return model.normalize(probe) == MARK + probe.replace(" ", MARK) and model.encode("a  b") != model.encode("a b")


def _pieces(text: str, most: int) -> Iterator[str]:
    begin = 0
    while len(text) - begin > most and (cut := SAFE.search(text, begin + most)):
        yield text[begin : cut.start()]
        begin = cut.end()
    yield text[begin:]


def _counter(model_path: str):
    def lengths(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        most = LONG_CHARS if _splits_safely(model) else 1 << 62

        def flush() -> None:
            for row, ids in zip(rows, model.encode(texts, num_threads=1), strict=True):
                out[row] += len(ids)
            rows.clear()
            texts.clear()

        for array in arrays:
            out, rows, texts, held = [0] * len(array), [], [], 0
            for row, value in enumerate(array):
                text = value.as_py()
                for piece in _pieces(text, most) if text else ():
                    rows.append(row)
                    texts.append(piece)
                    held += len(piece) if piece.isascii() else len(piece.encode())
                    if held >= BATCH_BYTES:
                        flush()
                        held = 0
            if texts:
                flush()
            yield pa.array(out, pa.int64())

    # the annotations tell Spark that the function takes and gives iterators
    lengths.__annotations__ = {"arrays": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return lengths


def n_tokens(text: Column, model_path: str) -> Column:
    """The library's number of tokens of a whole text; null counts as empty, empty has 0."""
    return F.arrow_udf(_counter(model_path), LongType())(text)


def token_counts(docs: DataFrame, model_path: str, text: str = "text", limit: int = 4096) -> DataFrame:
    """docs with ``n_bytes``, ``n_tokens`` and ``over_limit``.

    Null texts count as empty (0 bytes, 0 tokens), repeated rows are counted each, an empty
    table gives an empty one, other columns stay and columns of these names are replaced. No
    shuffle: a scan, and one pass through the Arrow function.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    return (
        docs.withColumn("n_tokens", n_tokens(body, model_path))
        .withColumn("n_bytes", F.octet_length(body).cast("long"))
        .withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
    )
