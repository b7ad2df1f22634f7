"""Invariants of the library on literal cases; whole queries are held against their SQL."""

import math

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from phenolith.functions import expr
from phenolith.operators import cohort, dedup, fits, meta, mining, scoring, stats, subjects, tagging
from phenolith.plans import model
from phenolith.sources import ingest

SF = "/root/testdata/sf0.001"


def picked(spark, layer, choose):
    best = {}
    for lay, _, q, _, _, _, i, a, _ in model.option_rows():
        if lay == layer:
            best.setdefault(q, []).append((a, i))
    return spark.createDataFrame([(1, q, choose(v)) for q, v in best.items()], "subject_id long, question_id string, option_index int")


def scored(spark, answers, layer):
    return scoring.similarity_score(scoring.build_items(answers, model.options(spark), layer)).first()


def test_score_range_of_the_first_layer(spark):
    assert scored(spark, picked(spark, 1, lambda v: max(v)[1]), 1)["score_pct"] == 97.5
    assert scored(spark, picked(spark, 1, lambda v: max(i for _, i in v)), 1)["score_pct"] == 25.9


def test_numbers_of_questions_and_options():
    rows = model.option_rows()
    assert len({r[2] for r in rows if r[0] == 1}) == 12 and len({r[2] for r in rows if r[0] == 2}) == 32
    assert all(0 <= r[7] <= 1 for r in rows)


def test_measures_supersede_self_reports(spark):
    answers = picked(spark, 2, lambda v: max(v)[1])
    clinical = spark.createDataFrame([(1, "body_mass_index", 1.0)], "subject_id long, feature string, alignment double")
    items = scoring.build_items(answers, model.options(spark), 2, clinical, model.features(spark), model.constructs(spark))
    names = {r["feature"] for r in items.collect()}
    assert "body_mass_index" in names and "q_body_mass_index" not in names and len(names) == 32
    assert scoring.similarity_score(items).first()["depth_pct"] == 80


@pytest.mark.parametrize(("feature", "sex", "value", "alignment"), [("hdl_cholesterol", "M", 60.0, 0.9), ("hdl_cholesterol", "F", 60.0, 0.9), ("ldl_cholesterol", None, 100.0, 0.9), ("body_mass_index", "F", 22.0, 1.0), ("waist_circumference", None, 102.0, 0.45)])
def test_mapper_anchors(spark, feature, sex, value, alignment):
    r = spark.createDataFrame([(1, sex, feature, value)], "subject_id long, sex string, feature string, value double")
    assert scoring.map_panel(r, model.mappers(spark), model.segments(spark), model.features(spark)).first()["alignment"] == alignment


def test_missing_and_clamped_readings(spark):
    r = spark.createDataFrame([(1, None, "hdl_cholesterol", None), (2, "M", "hba1c", 99.0), (3, "M", "nonsense", 1.0)], "subject_id long, sex string, feature string, value double")
    out = {x["subject_id"]: x for x in scoring.map_panel(r, model.mappers(spark), model.segments(spark), model.features(spark)).collect()}
    assert out[1]["alignment"] is None and out[1]["warnings"] == "missing"
    assert out[2]["alignment"] == 0.1 and out[2]["warnings"] == "clamped"
    assert out[3]["status"] == "unmapped"


@pytest.mark.parametrize(("scores", "labels", "want"), [([1, 2, 3, 4], [0, 0, 1, 1], 1.0), ([1, 2, 3, 4], [1, 1, 0, 0], 0.0), ([5, 5, 5, 5], [0, 1, 0, 1], 0.5), ([1, 2], [1, 1], None)])
def test_auc_cases(spark, scores, labels, want):
    rows = spark.createDataFrame(list(zip(map(float, scores), labels, strict=True)), "s double, y int")
    assert stats.auc(rows, "s", "y").first()["auc"] == want


def test_auc_matches_all_pairs(spark):
    rows = [(math.sin(i * 7) * (1 + i % 5), int(i % 3 == 0)) for i in range(300)]
    wins = [(a > b) + 0.5 * (a == b) for a, y in rows if y for b, z in rows if not z]
    assert stats.auc(spark.createDataFrame(rows, "s double, y int"), "s", "y").first()["auc"] == pytest.approx(sum(wins) / len(wins))


def test_medians_of_groups(spark):
    import statistics

    groups = {"a": [3.0, 1.0, 2.0, 2.0], "b": [5.0], "c": [1.0, 9.0], "d": [math.sin(i * 3) for i in range(501)], "e": [7.0] * 6}
    rows = [(k, x) for k, v in groups.items() for x in v] + [("a", None), ("f", None)]
    out = stats.medians(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", "m").collect()
    assert {r["k"]: r["m"] for r in out} == {k: statistics.median(v) for k, v in groups.items()}


def test_reliability_bins_hold_every_row(spark):
    rows = spark.createDataFrame([(i / 100, i % 2) for i in range(101)], "p double, y int")
    assert stats.reliability_table(rows, "p", "y").agg(F.sum("n")).first()[0] == 101


def test_logistic_solution_has_no_gradient(spark):
    rows = spark.createDataFrame([(math.sin(i), i % 7, int(math.sin(i) + (i % 5) / 10 > 0.2)) for i in range(400)], "a double, b int, y int")
    fit = fits.logistic_fit(rows, ["a", "b"], "y")
    table = {r["feature"]: r for r in fit.table(spark).collect()}
    assert table["a"]["gradient_norm"] < 1e-8 and table["a"]["weight"] > 0


def test_posteriors_sum_to_one_and_are_the_priors_without_items(spark):
    p = expr.posteriors(F.lit(0.0), F.lit(0.0), F.lit(0.0))
    row = spark.range(1).select(*(c.alias(n) for n, c in p.items())).first()
    assert [round(x, 9) for x in row] == [0.70, 0.20, 0.08, 0.02]


@pytest.mark.parametrize(("items", "want"), [([1] * 7 + [9, 9], 7), ([1] * 6 + [9, 9, 9], None), ([0] * 9, 0)])
def test_phq9(spark, items, want):
    assert spark.range(1).select(expr.phq9([F.lit(x) for x in items]).alias("x")).first()["x"] == want


def test_horizon_labels(spark):
    rows = spark.createDataFrame([(1, 1, 120), (2, 1, 121), (3, 0, 120), (4, 0, 119)], "subject_id long, deceased int, permth_exm int")
    assert {r["subject_id"]: r["y"] for r in stats.horizon_label(rows).collect()} == {1: 1, 2: 0, 3: 0}


def test_wiki_ages_and_dates(spark):
    row = spark.range(1).select(ingest.wiki_age(F.lit("122 years, 164 days[b]")).alias("a")).first()
    assert row["a"] == pytest.approx(122.449)


@pytest.mark.parametrize(("a", "b", "want"), [("bob smith", "robert smith", True), ("mary ann jones", "mary jones", True), ("john smith", "jane smith", True), ("anna lee", "karl lee", False)])
def test_name_matches(spark, a, b, want):
    q = spark.createDataFrame([(1, a)], "id long, clean string")
    m = spark.createDataFrame([(b, 0)], "clean string, ord int")
    assert (subjects.fuzzy_name_join(q, m).count() == 1) is want


def test_clusters_of_a_long_chain(spark):
    pairs = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    assert {r["cluster"] for r in dedup.dup_clusters(pairs).collect()} == {0}


def test_pool_of_equal_studies(spark):
    rows = spark.createDataFrame([("x", i, 2.0, 1.0, 4.0, True) for i in range(3)], "biomarker_name string, study_id long, value double, ci_lower double, ci_upper double, has_ci boolean")
    p = meta.dl_pool(rows, ["biomarker_name"]).first()
    assert p["pooled"] == pytest.approx(2.0) and p["tau_squared"] == 0 and p["i_squared"] == 0 and p["same_direction"]


def test_mention_windows_merge(spark):
    text = " ".join(f"w{i}" if i not in (50, 60, 300) else "Rossi" for i in range(400))
    rows = subjects.mention_windows(spark.createDataFrame([(1, text, "Rossi"), (2, "a b c", "Nobody")], "doc_id long, text string, subject string")).collect()
    assert sorted((r["doc_id"], r["window"], len(r["text"].split(" "))) for r in rows) == [(1, 1, 50), (1, 2, 40), (2, 1, 3)]


def test_entry_and_registry(spark):
    assert entry.entry(spark).count() > 0
    names = entry.queries()
    assert len(names) > 100 and set(entry.oracle_sql()) <= set(names)


@pytest.mark.parametrize("name", ["similarity_score", "map_panel", "domain_scores", "auc", "score_distribution", "strata_grade", "evidence_score", "keyword_tags", "dup_clusters", "trait_frequency", "survey_answers", "cohort_scores", "phrase_lift", "smoking_status_mine", "mention_windows", "fuzzy_name_join", "ci_recover", "control_pct_mine", "corroboration_lock", "name_normalize", "html_to_profile"])
def test_queries_match_their_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations").split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = entry.queries()[name](spark, SF)
    columns = sorted(found.columns)
    plain = lambda v: None if v is None else round(float(v), 6) if isinstance(v, int | float) else str(v)
    key = lambda r: tuple((v is None, str(v)) for v in r)
    spark_rows = sorted((tuple(plain(r[c]) for c in columns) for r in found.collect()), key=key)
    sql_rows = con.sql(f"SELECT {', '.join(f'\"{c}\"' for c in columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert spark_rows == sorted((tuple(map(plain, r)) for r in sql_rows), key=key)


def test_windows_of_dense_mentions(spark):
    import re

    from phenolith.queries.text import SMOKE, SMOKING

    texts = [
        ("a", "Tobacco, a pipe and cigars: still smokes daily, é smoked for 40 years. Quit at age 90, 3 packs."),
        ("b", "smoked " * 30 + "never smoked" + " x" * 200 + " stopped 10 years ago with cigarettes"),
        ("b", "no word of it"),
        ("c", None),
    ]
    docs = spark.createDataFrame(texts, "subject string, text string")
    want = {}
    for who, t in texts:
        for m in re.finditer(SMOKE, t or ""):
            w = t[max(0, m.start() - 90) : m.end() + 90]
            for n, p in SMOKING.items():
                if re.search(p, w):
                    want.setdefault(n, []).append((who, " ".join(w.split())[:160]))
    out = {r["pattern"]: r for r in tagging.window_mine(docs, SMOKE, SMOKING).collect()}
    assert {n: (r["mentions"], r["individuals"], r["examples"]) for n, r in out.items()} == {n: (len(v), len({x for x, _ in v}), sorted({x for _, x in v})[:3]) for n, v in want.items()}
    assert len(SMOKING) == 11 and out["status_never"]["mentions"] > 5
    told = mining.direction_annotate(spark.createDataFrame([(1, "salt higher salt less salt")], "doc_id long, text string"), ["salt"]).first()
    assert (told["phrase"], told["windows"], told["direction"]) == ("salt", 3, "high (100%)")


def test_boilerplate_goes_and_sentences_stay(spark):
    text = "She walks daily.  We use cookies here. Read more. andobesity matters to ourCommunity now. trending now Short. The end of the story 0123."
    docs = spark.createDataFrame([(text,), (None,), ("",)], "text string")
    out = [r[0] for r in docs.select(tagging.clean_boilerplate(F.col("text"))).collect()]
    assert out == ["She walks daily. The end of the story 0123.", "", ""] or out[0].startswith("She walks daily.") and out[1:] == ["", ""]
    assert "cookies" not in out[0] and "Read more" not in out[0] and out[0].endswith("0123.")


def test_nicknames_are_written_out(spark):
    names = spark.createDataFrame([("gus smith",), ("minnie gerry",), ("nancy winnie",)], "n string")
    assert [" ".join(r[0]) for r in names.select(subjects.name_tokens(F.col("n"))).collect()] == ["augustus smith", "wilhelmina geraldine", "ann winifred"]


def test_all_links_of_a_bucket_against_brute_force(spark):
    """More than sixteen members of one bucket: every link between classes, every cluster."""
    import random
    import re

    rng = random.Random(6)
    base, rows = [f"{a}{b}{c}" for a in "bcd" for b in "aeiou" for c in "lmnrst"], []
    for k in range(60):
        words = list(base)
        for _ in range(rng.randint(0, 14)):
            words[rng.randrange(8, len(words))] = "x" + rng.choice("abcdefgh")
        rows.append((k, "one two three four", " ".join(words)))
    rows += [(60, "one two three four", rows[3][2]), (61, "other title of this", "a b c d e f g"), (62, "one two three four", "too short")]
    docs = spark.createDataFrame(rows, "doc_id long, title string, text string")
    sets = {}
    for i, _, t in rows:
        w = re.findall("[a-z]+", t)
        sets[i] = {tuple(w[j : j + 7]) for j in range(len(w) - 6)}
    del sets[61], sets[62]
    share = lambda a, b: len(sets[a] & sets[b]) / min(len(sets[a]), len(sets[b]))
    rep = {i: min(j for j in sets if sets[j] == sets[i]) for i in sets}
    want = {(a, b) for a in set(rep.values()) for b in set(rep.values()) if a < b and share(a, b) >= 0.6}
    found = {(r["a"], r["b"]): r["containment"] for r in dedup.containment_pairs(dedup.dup_classes(docs)).collect()}
    assert set(found) == want and all(abs(v - share(*k)) < 1e-6 for k, v in found.items())
    label = dict(rep)
    for _ in range(60):
        for a, b in want:
            low = min(label[a], label[b])
            label = {i: low if label[i] in (label[a], label[b]) else label[i] for i in label}
    members = {i: c for i, c in label.items() if list(label.values()).count(c) > 1}
    assert {r["doc_id"]: r["cluster"] for r in dedup.near_duplicate_clusters(docs).collect()} == members
    counts = {r["doc_id"]: r["n_candidates"] for r in dedup.dup_candidates(docs).collect()}
    assert counts == {i: 60 for i in range(61)}


def test_reasons_and_longer_phrases(spark):
    from phenolith.operators import phrases

    texts = ["He puts his long life down to olive oil. They thank their longevity to daily walks!", "She lived to 104 by eating fish; nothing else.", None]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    assert [r[0] for r in docs.select(phrases.attribution_phrases(F.col("text"))).collect()][:2] == [["olive oil", "daily walks"], ["eating fish"]]
    long = spark.createDataFrame([("good olive bread fresh morning",)], "text string").select(phrases.candidate_phrases(F.col("text"))).first()[0]
    assert "good olive bread fresh morning" in long and "olive bread fresh morning" in long and len(long) == 10


def test_survey_codes_become_options(spark):
    names = "subject_id long, sex string, smq020 int, smq040 int, alq101 int, alq130 int, huq010 int, hsd010 int, bmxwaist double, bpq020 int, mcq160e int, mcq160f int, bmxbmi double"
    rows = spark.createDataFrame([(1, "F", 1, 3, 1, 3, 0, 4, 85.0, 1, None, 2, 25.0), (2, "M", 2, None, 2, 9, 9, None, 85.0, 2, 2, 1, 18.4), (3, None, 7, 1, None, None, None, None, None, None, None, None, None)], names)
    out = {}
    for r in cohort.survey_answers(rows).collect():
        out.setdefault(r["subject_id"], {})[r["question_id"].removeprefix("q_")] = r["option_index"]
    assert out == {
        1: {"smoking": 1, "alcohol": 2, "self_rated_health": 2, "waist_circumference": 1, "hypertension": 3, "cardiovascular_event": 0, "body_mass_index": 2},
        2: {"smoking": 0, "alcohol": 0, "waist_circumference": 0, "hypertension": 0, "cardiovascular_event": 2, "body_mass_index": 3},
    }
    known = {(r[2], r[6]) for r in model.option_rows() if r[0] == 2}
    assert {q for q, _ in known} >= set(cohort.survey_recodes(rows))


def test_values_with_units(spark):
    texts = [
        (1, "Fasting glucose was 92 mg/dL in all. The serum CRP level of 1.2-3.4 mg/L; hall 90 percent. HDL cholesterol 50 ± 12 MG/DL and 5 apples"),
        (2, "Median telomere length 1,200.5 bp. glucose 5 mg/dLx"), (3, None), (4, ""), (5, "é" * 300 + " insulin 7 pmol/L"),
    ]
    out = mining.unit_mentions(spark.createDataFrame(texts, "doc_id long, text string")).orderBy("doc_id", "ord").collect()
    assert [tuple(r) for r in out] == [
        (1, 0, "Fasting glucose", 92.0, None, "mg/dL", "point_estimate"), (1, 1, "serum CRP", 1.2, 3.4, "mg/L", "range"), (1, 3, "HDL cholesterol", 50.0, 12.0, "MG/DL", "mean_sd"),
        (2, 0, "telomere length", 1200.5, None, "bp", "median"), (5, 0, "insulin", 7.0, None, "pmol/L", "point_estimate"),
    ]
    told = spark.createDataFrame([(1, "smoking odds ratio 2.5 (95% CI 1.1-3.0) only")], "doc_id long, text string")
    assert [(r["measure"], r["value"]) for r in mining.biomarker_mentions(told).collect()] == [("OR", 2.5)]
