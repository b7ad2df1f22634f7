"""What larger tables ask of the queries: ids of more digits, and steps that grow no faster than their input."""

import re
import tracemalloc

import duckdb
import numpy as np
from pyspark.sql import functions as F

import __spark_entry__ as entry
from phenolith.llm import suffix_dedup
from phenolith.operators import dedup, dictionary, meta, mining, phrases, tagging
from phenolith.plans.lexicon import BOILERPLATE, GLUED, JUNK_SUBSTRINGS, JUNK_WORDS, LONG_LIVES, PERSON_AGES

SMALL = "/root/testdata/sf0.001"


def copied(spark, folder, shift, *tables):
    """Tables of the smallest size with their keys shifted, in a new folder, and a DuckDB that sees them."""
    db = duckdb.connect()
    for name in tables:
        t = spark.read.parquet(f"{SMALL}/{name}.parquet")
        t.withColumn("doc_id", F.col("doc_id") + shift).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet/*.parquet'")
    return str(folder), db


def test_corpus_union_ids_of_six_digits(spark, tmp_path):
    folder, db = copied(spark, tmp_path, 99_990, "documents")
    ours = {r["record_id"] for r in entry.queries()["corpus_union"](spark, folder).collect()}
    theirs = {r[0] for r in db.execute(f"SELECT record_id FROM ({entry.oracle_sql()['corpus_union']})").fetchall()}
    assert ours == theirs and {"AP_99990", "NA_99991", "AP_100000", "NA_100001"} <= ours


def test_phrases_of_the_corpus_are_filtered_before_they_are_shuffled(spark, tmp_path):
    """Only phrases that are frequent in the focus class go on to the counts by country and person."""
    rows = [(i, i % 2 == 0, 1.0, "de", f"s{i % 3}", ["olive oil", f"rare {i}"] if i % 2 == 0 else [f"odd {i}", "olive oil", None]) for i in range(60)]
    docs = spark.createDataFrame([*rows, (60, True, 1.0, "fr", "s9", None)], "doc_id long, focus boolean, weight double, country string, individual string, noun_phrase array<string>")
    bits = phrases.hash_filter(docs.where("focus").select(F.explode(phrases.phrase_hashes(F.col("noun_phrase"), "noun_phrase")).alias("h")).groupBy("h").count().where("count >= 3").select("h"))
    held = docs.select("doc_id", phrases.phrases_in(F.col("noun_phrase"), "noun_phrase", spark.sparkContext.broadcast(bits)).alias("p")).collect()
    assert [r["p"] for r in held] == [["olive oil"]] * 60 + [[]]
    assert [tuple(r)[:4] + tuple(r)[6:8] for r in phrases.phrase_lift(docs, {"noun_phrase": (3, 0.5)}).collect()] == [("noun_phrase", "olive oil", 30, 60, 1, 3)]


def test_phrases_of_long_and_odd_texts(spark, monkeypatch):
    """Texts in blocks of any size give the phrases that a plain search gives, in its order."""
    texts = ["", None, "Olive Öl oil, the garden soup; soup garden soup soup garden", "study data study", "x" * 30 + " garden path" * 40, "strong olive oil " * 3, "Kale salad\n\nbowl"]
    monkeypatch.setattr(phrases, "BLOCK_BYTES", 40)

    def plain(text):
        words = re.findall("[a-z]+", (text or "").lower())
        found = [tuple(words[i : i + n]) for n in range(2, 6) for i in range(len(words) - n + 1)]
        kept = [" ".join(g) for g in found if all(map(phrases.good_word, g)) and set(g) - set(JUNK_WORDS)]
        return list(dict.fromkeys(kept))

    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string").coalesce(1)
    assert [r["p"] for r in df.select(phrases.candidate_phrases(F.col("t")).alias("p")).collect()] == [plain(t) for t in texts]


def test_phrases_are_counted_in_steps_between_hashes():
    """Steps of any width come back as the ids of each part, none more often than a floor asks for."""
    ids = np.sort(np.concatenate([[0, 0, 0, 0, 65534, 65535, 65536, (1 << 20) - 1, 1 << 20, (1 << 32) - 1], np.random.default_rng(1).integers(0, 1 << 32, 5000), [7 << 20] * 9]))
    part, at, steps = phrases._packed(ids, 3)
    back = np.concatenate([(int(p) << 20) + phrases._unpacked(steps[a:b].tobytes()) for p, a, b in zip(part, at[:-1], at[1:], strict=True)])
    every, n = np.unique(ids, return_counts=True)
    assert np.array_equal(back, np.repeat(every, np.minimum(n, 3))) and len(steps) <= len(ids) + 16 * (1 << 12)


def test_phrases_of_texts_are_counted_where_they_are_found(spark, monkeypatch):
    """No array of all phrases is made, what a task holds is bounded, and phrases meet in one exchange; the rows are those of arrays."""
    for name, most in (("FOUND_BYTES", 60), ("HELD_HASHES", 7), ("HELD_ROWS", 5)):
        monkeypatch.setattr(phrases, name, most)
    words = ["olive", "garden", "soup", "bread", "study", "the"]
    texts = [" ".join(words[(i * j + j // 3) % 6] for j in range(i % 9 + 2)) for i in range(80)] + ["", None, "OLIVE Öl garden"]
    rows = [(i, i % 3 != 1, None if i % 11 == 0 else i / 4, [None, "de", "fr"][i % 3], f"s{i % 7}" if i % 5 else None, t, ["luck", "luck", None] if i % 2 else None) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, focus boolean, weight double, country string, individual string, noun_phrase string, attribution array<string>")
    floors = {"noun_phrase": (4, 0.9), "attribution": (3, 0.5)}
    found = phrases.phrase_lift(docs, floors, ["noun_phrase"])
    by = {}
    for _, focus, weight, country, person, text, told in rows:
        tokens = re.findall("[a-z]+", (text or "").lower())
        grams = {tuple(tokens[i : i + n]) for n in range(2, 6) for i in range(len(tokens) - n + 1)}
        for key in [("noun_phrase", " ".join(g)) for g in grams if all(map(phrases.good_word, g)) and set(g) - set(JUNK_WORDS)] + [("attribution", x) for x in set(told or []) - {None}]:
            by.setdefault(key, []).append((focus, weight, country, person))
    n_focus, plain = sum(r[1] for r in rows), {}
    for key, each in by.items():
        inside = sum(e[0] for e in each)
        lift = inside / n_focus / (len(each) / len(rows))
        if inside >= floors[key[0]][0] and lift >= floors[key[0]][1]:
            plain[key] = (inside, len(each), round(sum(e[1] or 0 for e in each) + 1e-9, 2), round(lift + 1e-9, 3), len({e[2] for e in each if e[0]} - {None}), len({e[3] for e in each} - {None}))
    assert {tuple(r)[:2]: tuple(r)[2:8] for r in found.collect()} == plain and len(plain) > 20
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("hashpartitioning(") == 1 and "ArrowEvalPython" not in plan


def test_texts_without_a_label_are_not_shuffled(spark, monkeypatch):
    """Labels of many documents, of some twice, give the counts of a plain join; only texts with a label, and few others, go through it."""
    texts = [" ".join(f"{a} {b}" for a in ("olive", "garden", "soup")[: i % 3 + 1] for b in ("bread", "rest")[: i % 2 + 1]) for i in range(60)]
    docs = spark.createDataFrame([(i if i < 58 else None, 1.5, "de", f"s{i % 7}", t) for i, t in enumerate(texts)], "doc_id long, weight double, country string, individual string, noun_phrase string")
    labels = spark.createDataFrame([(i, i % 4 != 1) for i in range(0, 40)] + [(3, True), (3, True), (5, True), (99, True), (7, None), (None, True)], "doc_id long, focus boolean")
    floors = {"noun_phrase": (3, 0.2)}
    small = sorted(map(tuple, phrases.phrase_lift(docs, floors, ["noun_phrase"], labels).collect()))
    monkeypatch.setattr(phrases, "DIMENSION_ROWS", 2)
    found = phrases.phrase_lift(docs, floors, ["noun_phrase"], labels)
    joined = docs.join(labels, "doc_id", "left").withColumn("focus", F.coalesce("focus", F.lit(False)))
    assert sorted(map(tuple, found.collect())) == small == sorted(map(tuple, phrases.phrase_lift(joined, floors, ["noun_phrase"]).collect())) and len(small) > 5
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in plan.split("MapInArrow find")[1] and plan.split("Union")[1].count("ArrowEvalPython [held(") >= 2


def test_registry_phrases_are_found_in_texts_without_arrays_of_all(spark):
    """Texts and arrays give one set of columns a document; the registry is made once and no array of all phrases is."""
    asked = spark.sparkContext.accumulator(0)

    def seen(n):
        asked.add(1)
        return n

    registry = spark.createDataFrame([("olive oil", 1), ("garden soup", 1), ("garden soup", 3), ("luck", 2), (None, 5)], "phrase string, n long").coalesce(1)
    registry = registry.select("phrase", F.udf(seen, "long")("n").alias("n_countries"))
    rows = [(1, "Olive oil, GARDEN soup; olive oil", ["luck", None]), (2, None, None), (3, "garden the soup", []), (3, "good olive oil", None), (4, "x", ["olive oil", "olive oil"]), (None, "olive oil", ["luck"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, phrases array<string>")
    found, vocabulary = phrases.feature_vectors(docs, registry, text="text")
    assert {tuple(r)[::2] for r in vocabulary.where("phrase is not null").collect()} == {("garden soup", 1), ("luck", 2), ("olive oil", 3)}
    assert {r["doc_id"]: (r["columns"], r["cross_cultural"]) for r in found.collect()} == {1: ([1, 2, 3], True), 2: ([], False), 3: ([3], False), 4: ([3], False), None: ([], False)}
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert asked.value == 5 and plan.count("hashpartitioning(") == 1 and "ArrowEvalPython" not in plan


def test_boilerplate_is_looked_for_only_where_it_can_be(spark):
    """The patterns' plan tries replacements behind a plain search, and the texts are those of all replacements in turn."""
    texts = ["The team met. Cookie Policy of ours is here now. We like ourterms and PIANO meteractive meterexpired callbackevent things.", "aB andObesity tobaccoas. Short. A whole sentence stays here.", "the Local community thelocal community. A fine sentence is here", "", None]

    def plain(text):
        text = text or ""
        for pattern, parts in GLUED:
            text = re.sub(pattern, parts.replace("$", "\\"), text)
        for j in JUNK_SUBSTRINGS:
            text = re.sub("(?i)" + re.escape(j), " ", text)
        each = [s.strip() for s in re.split(r"(?<=[.!?])\s+(?=[A-Z\"'])", re.sub(r"\s+", " ", text).strip())]
        return " ".join(s for s in each if len(s) >= 12 and not re.search("(?i)(?:" + "|".join(BOILERPLATE) + ")", s))

    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string").coalesce(1)
    assert [r["c"] for r in df.select(tagging.clean_boilerplate(F.col("t")).alias("c")).collect()] == [plain(t) for t in texts]
    assert tagging.shortest(["cookies", "cookie", "a cookie", "menu"]) == ["cookie", "menu"]


def test_effects_are_found_stretch_by_stretch(spark):
    """A paper's effects are those of one walk over its whole text, wherever its full stops are; each stretch without a measure is passed over."""
    texts = [
        "Body mass OR 1.2 (95% CI 0.9-2.1); glucose HR 1.3. CRP. RR: 0.5 (0.5 - 3.1)", "No ratio here. Hazard Ratio = 3. odds ratio 1.5.HR 2..OR 7", "name. OR 2 HR 1.3, all 3.4.5 RR 2.", "vitamin D.\nOR 4. (95% CI 1-2)", "OR", "", None,
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    whole = df.select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(mining.EFFECT), 0)).alias("ord", "hit")).select("doc_id", "ord", F.regexp_extract("hit", mining.EFFECT, 3).try_cast("double").alias("value"))
    found = mining.biomarker_mentions(df)
    assert sorted(map(tuple, found.select("doc_id", "ord", "value").collect())) == sorted(map(tuple, whole.collect()))
    assert "split(text" in found._jdf.queryExecution().optimizedPlan().toString()


def test_studies_collapse_in_one_exchange(spark):
    """Mentions are neither read twice nor joined with their own medians."""
    rows = [("b", 1, 3, 1.0, 0.5, 2.0), ("b", 1, 2, 2.0, 1.0, 3.0), ("b", 1, 1, 9.0, None, None), ("b", 2, 1, 4.0, None, None), ("b", 2, 2, 5.0, None, None), ("b", 3, 1, None, None, None)]
    studies = meta.study_collapse(spark.createDataFrame(rows, "biomarker_name string, study_id long, ord long, value double, ci_lower double, ci_upper double"), ["biomarker_name"])
    assert {r["study_id"]: tuple(r)[2:] for r in studies.collect()} == {1: (2.0, 1.0, 3.0, True), 2: (4.5, None, None, False), 3: (None, None, None, False)}
    plan = studies._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Initial Plan")[-1].count("Exchange") == 1 and "Join" not in plan


def test_a_shard_of_runs_is_sorted_in_little_memory():
    """Two workers of an executor sort a shard each beside its JVM."""
    n = suffix_dedup.SHARD_BYTES // 75
    rng = np.random.default_rng(1)
    text, sizes = rng.integers(97, 101, n * 10, dtype=np.uint8), np.full(n, 75)
    data = text[(rng.integers(0, len(text) - 75, n)[:, None] + np.arange(75)).ravel()]
    tracemalloc.start()
    suffix_dedup.resolve(np.sort(rng.integers(0, n // 6, n).astype(np.uint64)), rng.integers(0, 60000, n), data, np.arange(n) * 75, sizes, 50)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200e6


def test_a_set_is_sent_to_blocks_not_to_pairs(spark, monkeypatch):
    """Pairs of a bucket meet at one place, or block by block if its sets are large; neither changes a link."""
    words = [f"{a}{b}{c}" for a in "bdfg" for b in "aeiou" for c in "klmnrst"]
    texts = [" ".join(words[:30] + words[30 + i : 60 + i] + [words[-1 - i]] * (i % 3)) for i in range(24)] + ["short", None]
    docs = spark.createDataFrame([(i, t, "one title for all") for i, t in enumerate(texts)], "doc_id long, text string, title string")

    def shingles(t):
        w = (t or "").split()
        return {tuple(w[i : i + 7]) for i in range(len(w) - 6)}

    sets = {i: shingles(t) for i, t in enumerate(texts) if shingles(t)}
    share = {(a, b): round(len(sets[a] & sets[b]) / min(len(sets[a]), len(sets[b])), 6) for a in sets for b in sets if a < b}
    classes = dedup.dup_classes(docs)
    pairs = dedup.prefix_pairs(classes, spark.createDataFrame([], "doc_id long, cluster long"), 0.6)
    assert dedup.meetings(pairs, classes).select("g").distinct().count() == 1
    monkeypatch.setattr(dedup, "BLOCK_SHINGLES", 300)
    assert 1 < dedup.meetings(pairs, classes).select("g").distinct().count() <= 25
    assert {(r["a"], r["b"]): r["containment"] for r in dedup.containment_pairs(classes).collect()} == {p: c for p, c in share.items() if c >= 0.6}


def test_patterns_are_tried_between_full_stops(spark):
    """Mentions, ages and gates found stretch by stretch are those of one walk over the whole text."""
    texts = ["walk. walking on.\nthe walker; no. tai chi", "a.b walk", "", None, "none here. 12. at the age of 99. aged 101.5 and aged\n97", "é. Walks é walk. 98 years old.", "long. lived long-lived walk"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).withColumn("t", F.lower("text"))
    for pattern in (r"\bwalk\w*|tai chi", r"walk[^x]on", r"a\.b", r"x?"):
        whole = [(r["doc_id"], [tuple(x) for x in r["s"]]) for r in df.select("doc_id", tagging.spans_of(F.col("t"), pattern).alias("s")).where("size(s) > 0").collect()]
        assert [(r["doc_id"], [tuple(x) for x in r["spans"]]) for r in tagging.mentions(df, "t", {"p": pattern}).collect()] == whole
    assert [dictionary.stopless(p) for p in (r"\bwalk\w*|tai chi", "a.c", "[^x]", r"\S", r"a\.b", "(?<=a)b", "[+-9]", r"long[-\s]lived")] == [True, *[False] * 6, True]
    assert all(map(dictionary.stopless, PERSON_AGES))
    assert [r["h"] for r in df.select(tagging.holds(F.col("t"), LONG_LIVES).alias("h")).collect()] == [False] * 6 + [True]
    ages = {(r["doc_id"], r["at"], r["age"]) for r in mining.age_positions(df).collect()}
    assert ages == {(i, m.start(), int(m[1])) for i, t in enumerate(texts) for p in PERSON_AGES for m in re.finditer(p, (t or "").lower()) if 95 <= int(m[1]) <= 135}
    plan = mining.name_positions(df, spark.createDataFrame([("ada walk",)], "clean string"))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "regexp_extract_all(t" not in plan.split("Generate explode")[-1]
