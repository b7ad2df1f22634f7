"""A corpus pipeline of five stages, from documents to packed sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phenolith.llm import mixing, near_dup, packing, quality, suffix_dedup
from phenolith.llm.queries import WORDS_MODEL, tokenizer
from phenolith.llm.storage import documents, numbered, written

ROW, TURNS = "__row", "__turns"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, each row judged by its own text.

    Null and empty texts have no words and go. Columns and rows, repeated ones too, stay as they are;
    an empty table gives an empty one.
    """
    return quality.quality(docs, carry=True, prefix="__q_").where("__q_kept").select(*docs.columns)


def minhash_near_dup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group, that with the smallest doc_id, and all without words.

    Rows without a doc_id are linked by their texts and come last in their group; of rows that repeat
    a doc_id one stays. Columns stay as they are; an empty table gives an empty one.
    """
    rows = numbered(docs, ROW)
    gone = near_dup.near_duplicates(rows, row=ROW).where("not single").select(ROW)
    return rows.join(gone, ROW, "left_anti").select(*docs.columns)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that repeat from smaller doc_ids; those left empty go.

    A cut never leaves part of a character: what would stay of one is dropped with it. Texts without a
    cut are as they were, also those of rows without a doc_id. n_chars, if there, follows the text.
    """
    cut = suffix_dedup.remove_repeats(docs, with_text=True, prefix="__s_").where(F.octet_length("__s_kept") > 0)
    out = cut.withColumn("text", F.col("__s_kept"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them; the one at a source's cut is taken whole.

    Every row counts by itself, whatever its doc_id; texts without words are not taken.
    """
    rows = numbered(docs, ROW)
    mixed = mixing.mix_sources(rows, whole=True, row=ROW).where("taken > 0")
    times = mixed.select(ROW, F.sequence(F.lit(1), F.try_divide("taken", "size").cast("int")).alias(TURNS))
    return rows.join(times, ROW).withColumn(TURNS, F.explode(TURNS)).select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences of 4096 tokens; every row is a document.

    A null text is packed as an empty one, which is its closing id alone.
    """
    return packing.pack_documents(docs, tokenizer(WORDS_MODEL))


STAGES = [
    ("quality rules", quality_rules),
    ("MinHash near-dedup", minhash_near_dup),
    ("suffix-array dedup", suffix_array_dedup),
    ("mixing sources to target weights", mixing_sources),
    ("best-fit packing", best_fit_packing),
]
#: Distances against hashed references, and the token ids of a library, are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each to the written result of the one before.

    What nulls, empty and repeated rows give is said by the stages; an empty table gives no pieces. Columns beside
    those of documents are carried up to the packing.
    """
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "stage-" + name.split()[0].lower())
    return STAGES[-1][1](spark, docs, sf_dir)
