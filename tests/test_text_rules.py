"""Literal cases of the text operators, and whole joins by brute force."""

import random

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from phenolith.operators import meta, mining, phrases, subjects, tagging
from phenolith.operators.dictionary import contained, matching, needles, words_pattern
from phenolith.plans.lexicon import TRAITS


def test_all_similar_names_are_found(spark):
    """Equal to all pairs on 5000 names with typos at every place, names of up to six errors included."""
    rng = random.Random(3)
    first = "james mary christopher alexandra bartholomew jo ann wilhelmina maximiliana li".split()
    part = "an ber co dor el fin gra hol ix jo kan lor mer nov".split()
    name = lambda: " ".join([*(rng.choice(first) for _ in range(rng.choice([1, 1, 2, 3]))), "".join(rng.choice(part) for _ in range(rng.choice([1, 2, 3, 5, 9])))])

    def typo(text):
        letters = list(text)
        for _ in range(rng.choice([0, 1, 1, 2, 3, 4])):
            i, kind = rng.randrange(len(letters)), rng.random()
            letters[i : i + (kind < 0.7)] = [] if 0.4 < kind < 0.7 else [rng.choice("abcdefgh")]
        return " ".join("".join(letters).split())

    known = list(dict.fromkeys(name() for _ in range(2500)))
    asked = list(dict.fromkeys(typo(rng.choice(known)) for _ in range(2500)))
    a, b = pd.DataFrame({"a": asked}), pd.DataFrame({"b": known})
    want = duckdb.sql("SELECT a, b FROM a, b WHERE 1 - levenshtein(a, b) / greatest(length(a), length(b)) >= 0.9").fetchall()
    found = [(r["a"], r["b"]) for r in subjects.similar_pairs(spark.createDataFrame(a), spark.createDataFrame(b)).collect()]
    assert len(want) > 1000 and sorted(found) == sorted(want)


@pytest.mark.parametrize(
    ("asked", "known", "match"),
    [
        ("bob smith", "robert smith", True), ("mary ann jones", "mary jones", True), ("john smith", "jane smith", True), ("anna lee", "karl lee", False), ("jonathan smyth", "jonathan smith", True), ("jonathan xmith", "jonathan smith", True),
        ("", "ann", False), ("a b c d e f g h", "h g f", True), ("h g f", "a b c d e f g h", True), ("xonathan smith", "jonathan smith", True),
    ],
)
def test_names_match(spark, asked, known, match):
    q, m = spark.createDataFrame([(1, asked), (1, asked)], "id long, clean string"), spark.createDataFrame([(known, 7), ("some one else", 1)], "clean string, ord long")
    assert [r["match"] for r in subjects.fuzzy_name_join(q, m).collect()] == [known] * match


def test_the_first_entry_of_the_registry_wins(spark):
    q = spark.createDataFrame([(1, "john smith"), (2, None)], "id long, clean string")
    m = spark.createDataFrame([("john smith", 5), ("jane smith", 2), ("john a smith", 3)], "clean string, ord long")
    assert [tuple(r) for r in subjects.fuzzy_name_join(q, m).collect()] == [(1, "john smith", "jane smith")]
    assert subjects.fuzzy_name_join(q.limit(0), m).count() == subjects.fuzzy_name_join(q, m.limit(0)).count() == 0


def windows(spark, text, subject, width=40):
    df = spark.createDataFrame([(1, text, subject)], "doc_id long, text string, subject string")
    return [r["text"] for r in subjects.mention_windows(df, width).orderBy("window").collect()]


def test_mention_windows(spark):
    words = [f"w{i}" for i in range(90)]
    at = lambda *places: " ".join("Rossi's" if i in places else w for i, w in enumerate(words))
    one = windows(spark, at(45), "Maria Rossi")
    assert len(one) == 1 and len(one[0].split()) == 40 and one[0].split()[20] == "Rossi's"
    assert [len(w.split()) for w in windows(spark, at(10, 51, 89), "Maria Rossi")] == [30, 59]
    assert windows(spark, " ".join(words), "Maria Rossi") == [" ".join(words[:20])]  # no mention: the opening
    assert windows(spark, " ".join(words), "") == windows(spark, " ".join(words), None) == [" ".join(words[:20])]
    assert windows(spark, "one MARIA! two", "Maria Rossi") == ["one MARIA! two"]  # the first name
    assert windows(spark, "a b c d José e", "Jose Li", 4) == ["c d José e"]  # a last name of two letters is none; accents do not count
    assert windows(spark, None, "Maria Rossi") == windows(spark, "  \n", "x") == []


def papers(spark, texts):
    return spark.createDataFrame([(i, t, True, True) for i, t in enumerate(texts)], "doc_id long, text string, has_effect boolean, has_percent boolean")


def test_lock_wants_one_mention_without_a_design(spark):
    far = " and so on" * 20
    clean = ["Longevity and walking."] * 81 + [f"Longevity: the study sample{far} walking{far} recruit walking"] * 50  # one of two mentions is clean
    design = ["Longevity; walking was recruited for."] * 20
    row = mining.corroboration_lock(papers(spark, clean + design), {"walking daily": "physical_activity", "music": "x"}).where("trait = 'walking daily'").first()
    assert (row["paper_count_raw"], row["paper_count"], row["tier"], row["baseline_source"], row["gold_eligible"]) == (151, 131, "silver", "nhanes", True)
    few = {r["trait"]: r for r in mining.corroboration_lock(papers(spark, [*design[:3], "Lifespan, music, controls", "no context: music"]), {"walking daily": "z", "music": "x"}).collect()}
    assert few["walking daily"]["paper_count"] == 3 and few["walking daily"]["baseline_source"] == "none"
    assert (few["music"]["paper_count"], few["music"]["tier"], few["music"]["baseline_source"], few["music"]["gold_eligible"]) == (1, "bronze", "corpus_control", False)


def test_control_percentages_stand_beside_controls(spark):
    texts = ["Longevity. Music was heard by 40% of cases. Controls were matched by age.", "Lifespan: music in 12.5 % of the controls", "longevity: controls 30% music, controls 31% music", "music 9% of controls"]
    row = mining.control_pct_mine(papers(spark, texts), ["music", "chocolate"]).orderBy("trait").collect()
    assert [tuple(r) for r in row] == [("chocolate", 0, 0, "", "silver_pending"), ("music", 3, 3, "12.5|30|30", "materialized")]


def test_directions_vote_once_a_mention(spark):
    docs = ["walking was high, high, high and greater", "less walking", "low walking", "walking", "unsalted salt, none", None]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    found = {r["phrase"]: (r["windows"], r["direction"]) for r in mining.direction_annotate(df, ["walking a lot", "salt", "salt (x)", "abc"]).collect()}
    assert found == {"walking a lot": (4, "low (67%)"), "salt": (1, ""), "salt (x)": (1, "")}
    many = spark.createDataFrame([(i, "high tide here" if i < 300 else "low tide") for i in range(400)], "doc_id long, text string")
    assert mining.direction_annotate(many, ["tide"]).first()["direction"] == "high (100%)"


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("120 people; 130 mg; page 101", []),
        ("She is 104 years old", [(None, 104)]),
        ("aged 98, then a 111-year-old", [(None, 111)]),
        ("Maria Rossi, a 104-year-old, met Anna Schmidt, aged 99", [("anna schmidt", 99)]),  # 14 characters apart, 15 the others
        ("aged 99 xx Maria Rossi xx aged 101", [("maria rossi", 99)]),  # equally near: the first
        ("Maria Rossi" + " so" * 250 + " turned 111 and was aged 98", [(None, 98)]),  # too far: the first kind of age
        ("turned 94, turned 136", []),
    ],
)
def test_ages_of_people(spark, text, want):
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    names = spark.createDataFrame([("maria rossi",), ("anna schmidt",)], "clean string")
    assert [(r["name"], r["age"]) for r in mining.age_person_mentions(docs, mining.name_positions(docs, names)).collect()] == want


def test_traits_of_articles(spark):
    rows = [(1, "Ann Lee", True, None, True, None, True), (2, "Bo Li", False, "nonagenarian", False, "s", False), (3, "Cy Ko", False, "centenarian", False, "s", True), (4, None, False, "nonagenarian", True, "s", True)]
    docs = spark.createDataFrame(rows, "doc_id long, person string, verified boolean, tier string, is_profile boolean, source string, tagged boolean")
    w = spark.createDataFrame([(i, k, t) for i in range(1, 5) for k, t in ((1, "Yoga, no more"), (2, "a long window with yoga"))], "doc_id long, window long, text string")
    found = mining.trait_mentions(docs, w, {"yoga": (r"\byoga\b", "physical_activity")}, {"tagged": ("active", "physical_activity")})
    assert sorted(map(tuple, found.collect())) == [
        ("Ann Lee", True, "active", "physical_activity", "unknown", "a long window with yoga", "boolean"),
        ("Ann Lee", True, "yoga", "physical_activity", "unknown", "Yoga, no more", "keyword"),
        ("Bo Li", False, "yoga", "physical_activity", "s", "Yoga, no more", "keyword"),
    ]


def test_phrases_without_function_words_and_junk(spark):
    text = "The adjusted cohort studies of strong olive oil andobesity garden soup, study data garden."
    found = spark.range(1).select(phrases.candidate_phrases(F.lit(text)).alias("p")).first()["p"]
    assert set(found) == {"strong olive", "olive oil", "strong olive oil", "garden soup", "soup study", "garden soup study", "soup study data", "garden soup study data", "data garden", "study data garden", "soup study data garden", "garden soup study data garden"}


def test_dictionaries(spark):
    df = spark.createDataFrame([("insulin-like growth factor",), ("nothing",), (None,), ("",)], "t string")
    groups = [["insulin"], ["growth", "factor"], [], ["in", "zzz"], [""]]
    assert [r["c"] for r in df.coalesce(1).select(contained(F.col("t"), groups).alias("c")).collect()] == [[0, 1, 3, 4], [3, 4], [], [4]]
    texts = ["she does yoga and never smoked", "tai chi classes, running", "reads", "", "the spin class of a runner", "no worries"]
    low = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    patterns = {t: p for p, t, _ in TRAITS}
    import re

    want = sorted((i, n) for i, t in enumerate(texts) for n, p in patterns.items() if re.search(p, t))
    assert sorted((r["i"], r["name"]) for r in matching(low, "t", patterns).collect()) == want
    assert needles(r"a?b*") == [""] and needles(words_pattern(["steps", "tai chi"])) == ["steps", "tai chi"]


def test_canonical_names(spark):
    raw = ["IGF-1 and insulin", "HDL cholesterol", "riscos de morir", "each scored", "nothing much", "weighting but not diabetes", "The grs", None, "Body mass index"]
    found = {r["biomarker_name"]: r for r in meta.canonical_names(spark.createDataFrame([(r,) for r in raw], "biomarker_name string")).collect()}
    assert (found["IGF-1 and insulin"]["canonical"], found["IGF-1 and insulin"]["rule"]) == ("igf_1", "matched:igf-1")
    assert found["HDL cholesterol"]["note"] == "formatting_only" and found["HDL cholesterol"]["review_priority"] == "none"
    assert found["riscos de morir"]["canonical"] == "riscos_morir" and found["riscos de morir"]["review_priority"] == "high"
    assert found["each scored"]["canonical"] == "each_scored" and "EXTRACTION_GARBAGE" in found["each scored"]["note"]
    assert found["The grs"]["canonical"] == "the_grs" and found["weighting but not diabetes"]["canonical"] == "diabetes"
    kept = meta.canonical(spark.createDataFrame([(r, 1) for r in raw], "biomarker_name string, n long")).collect()
    assert {r["biomarker_name"] for r in kept} == {"IGF-1 and insulin", "HDL cholesterol", "riscos de morir", "nothing much", "The grs", "Body mass index"}


@pytest.mark.parametrize(("url", "country"), [("https://www.LEMONDE.fr/x", "France"), ("https://bbc.co.uk/", "UK"), ("https://a.com.au/", "Australia"), ("https://aarp.org", "USA"), ("https://x.net", "Unknown"), (None, "Unknown")])
def test_countries_of_sites(spark, url, country):
    assert spark.range(1).select(tagging.domain_country(F.lit(url).cast("string")).alias("c")).first()["c"] == country


def test_feature_vectors(spark):
    docs = spark.createDataFrame([(1, ["olive oil", "garden soup", "olive oil"]), (2, None), (3, ["unknown"])], "doc_id long, phrases array<string>")
    registry = spark.createDataFrame([("olive oil", 1), ("garden soup", 1), ("garden soup", 3)], "phrase string, n_countries long")
    rows, vocabulary = phrases.feature_vectors(docs, registry)
    assert {r["doc_id"]: (r["columns"], r["cross_cultural"]) for r in rows.collect()} == {1: ([0, 1], True), 2: ([], False), 3: ([], False)}
    assert {r["phrase"]: r["column"] for r in vocabulary.collect()} == {"garden soup": 0, "olive oil": 1}
    with pytest.raises(ValueError, match="more than 1"):
        phrases.feature_vectors(docs, registry, most=1)
