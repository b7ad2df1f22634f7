"""The stages of the pipeline, each against brute force on what the one before kept."""

import zlib
from array import array
from collections import Counter

from tests.llm.test_llm import WORD, near_by_hand, quality_by_hand

from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from phenolith.llm.queries import WORDS_MODEL, tokenizer

SF = "/root/testdata/sf0.001"


def removed_text(rows, length=50):
    low = {}
    for r in rows:
        t = r["text"].encode()
        for i in range(len(t) - length + 1):
            low[t[i : i + length]] = min(low.get(t[i : i + length], r["doc_id"]), r["doc_id"])
    out = {}
    for r in rows:
        t = r["text"].encode()
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if low[t[i : i + length]] < r["doc_id"]:
                gone[i : i + length] = b"\x01" * length
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        if kept:
            out[r["doc_id"]] = kept.decode(errors="replace").replace("�", "")
    return out


def test_stages_against_brute_force(spark):
    stage = dict(pipeline.STAGES)
    assert list(stage) == [n for n, _ in pipeline.STAGES] and len(stage) == 5
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    rows, columns = docs.collect(), docs.columns

    good = stage["quality rules"](spark, docs, SF).cache()
    assert good.columns == columns
    kept = {r["doc_id"] for r in good.collect()}
    assert kept and not any(r["doc_id"] in kept for r in rows if quality_by_hand(r["text"])[5])

    single = stage["MinHash near-dedup"](spark, good, SF).cache()
    firsts = {r[0] for r in near_by_hand([(r["doc_id"], r["text"]) for r in good.collect()]) if r[3]}
    assert single.columns == columns and {r["doc_id"] for r in single.collect()} == firsts

    cut = stage["suffix-array dedup"](spark, single, SF).cache()
    assert cut.columns == columns
    assert {r["doc_id"]: r["text"] for r in cut.collect()} == removed_text(single.collect())

    mixed = stage["mixing sources to target weights"](spark, cut, SF).cache()
    times = Counter(r["doc_id"] for r in mixed.collect())
    assert mixed.columns == columns and max(times.values()) <= 3
    size = {r["doc_id"]: len(WORD.findall(r["text"])) for r in cut.collect()}
    by_source = Counter()
    for r in cut.collect():
        by_source[r["source"]] += size[r["doc_id"]] * times[r["doc_id"]]
    total = sum(size.values())
    assert abs(sum(by_source.values()) - total) <= sum(max((size[r["doc_id"]] for r in cut.collect() if r["source"] == s), default=0) for s in by_source)

    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer(WORDS_MODEL))
    want = Counter()
    for r in mixed.collect():
        ids = [*library.encode(r["text"], add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 4096):
            want[r["doc_id"], k // 4096, len(ids[k : k + 4096]), zlib.crc32(array("I", ids[k : k + 4096]).tobytes())] += 1
    packed = stage["best-fit packing"](spark, mixed, SF).collect()
    assert Counter((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in packed) == want
    assert {r["doc_id"] for r in pipeline.run(spark, SF).collect()} == {d for d, *_ in want}


def test_cuts_inside_characters(spark):
    passage = " shared words of a passage that two documents have alike, with nothing else "
    texts = [
        f"é{passage}é one end and a real \ufffd mark",  # é: C3 A9
        f"ũ{passage}è other end \ufffd",  # ũ: C5 A9, è: C3 A8; the cut takes A9 before and C3 after
        f"𐐨 start 😀{passage}€ tail",
        f"Ĩ 😁{passage}₭ last",  # € and ₭ share two bytes
        "plain text with its own \ufffd and nothing in common",
        f"ĩ{passage}ê",  # nothing stays but parts of characters
    ]
    docs = spark.createDataFrame([(i, t, len(t)) for i, t in enumerate(texts)], "doc_id long, text string, n_chars long")
    out = {r["doc_id"]: r for r in pipeline.suffix_array_dedup(spark, docs, SF).collect()}
    assert {k: r["text"] for k, r in out.items()} == {0: texts[0], 1: " other end \ufffd", 2: "𐐨 start 😀€ tail", 3: "Ĩ 😁 last", 4: texts[4]}
    assert all(r["n_chars"] == len(r["text"]) for r in out.values())


def test_stages_with_missing_and_repeated_ids(spark):
    long = lambda k, n=80: " ".join(f"{k}word{i}" for i in range(n))
    near = long("a").replace("aword7 ", "other ")
    rows = [(1, long("a"), "x", 5), (None, near, "x", 6), (None, near, "x", 6), (3, long("b", 60), "y", 1), (3, long("c", 90), "y", 1), (3, long("c", 90), "y", 1), (None, long("d"), None, 0), (None, None, None, None), (4, "", "x", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    single = pipeline.minhash_near_dup(spark, docs, SF)
    assert single.columns == docs.columns  # a column named like one of the operator's
    kept = sorted((r["doc_id"], r["text"]) for r in single.collect() if r["doc_id"] is not None)
    assert kept[0] == (1, long("a")) and kept[2] == (4, "") and kept[1][0] == 3 and len(kept) == 3
    assert sorted((r["text"] or "" for r in single.collect() if r["doc_id"] is None)) == ["", long("d")]

    mixed = pipeline.mixing_sources(spark, docs, SF).collect()
    times = Counter((r["doc_id"], r["text"]) for r in mixed)
    assert all(r["text"] for r in mixed) and max(times.values()) <= 6 and set(times) <= {(r[0], r[1]) for r in rows}
    none = docs.limit(0)
    for stage in (pipeline.quality_rules, pipeline.minhash_near_dup, pipeline.suffix_array_dedup, pipeline.mixing_sources, pipeline.best_fit_packing):
        assert stage(spark, none.withColumn("lang", F.lit(None).cast("string")), SF).count() == 0
