"""The operators against brute force on small tables with every awkward kind of row."""

import hashlib
import math
import random
import re
import zlib
from array import array
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from phenolith.llm import chat, license_scan, lm_score, mixing, near_dup, packing, quality, suffix_dedup, token_counts, topk
from phenolith.llm.queries import PIECES_MODEL, WORDS_MODEL, tokenizer

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string, kept int"
WORD = re.compile("[^\x20\x09-\x0d]+")


def _texts():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 9))) for _ in range(400)]
    base = [" ".join(rng.choice(vocabulary) for _ in range(n)) for n in (3, 5, 60, 120, 300, 700)]
    near = base[4].split()
    near[7] = "changed"
    passage = " ".join(rng.choice(vocabulary) for _ in range(30))
    return [
        *base,
        None,
        "",
        "   \n\t ",
        "one",
        "Two Words",
        base[4],
        base[4].upper(),
        " ".join(near),
        f"{base[2]}\n{passage}\nend of it",
        f"{passage} and {base[3][:100]}",
        "x" * 200_000,
        "word " * 3000,
        ("line again\n" * 40) + "é#*$%&|<>",
        "a  b   c▁d ▁e  f <s> </s> <|endoftext|> <|ENDOFTEXT|>",
        "released under the MIT License; Apache-License, Version 2.0 CC-BY-NC cc by nc",
        license_scan.TEMPLATES["gpl"].upper() + " tail",
        "under the mit\x00license ́x",
    ]


@pytest.fixture(scope="module")
def rows():
    rows = [(i, t, ["en", "de", None][i % 3], ["b", "a", None, "é"][i % 4], None, "clash", 7) for i, t in enumerate(_texts())]
    return [*rows, rows[4], rows[6], (None, _texts()[4], "en", "a", 1, "clash", 7), (None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def same(found, want):
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted((tuple(r) for r in found), key=key) == sorted(want, key=key)


def test_token_counts(docs, rows, empty):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=tokenizer(PIECES_MODEL))
    assert token_counts._splits_safely(model)
    want = []
    for r in rows:
        t = r[1] or ""
        n = len(model.encode(t))
        want.append((r[0], len(t.encode()), n, n > 4096))
    out = token_counts.token_counts(docs, tokenizer(PIECES_MODEL))
    same(out.select("doc_id", "n_bytes", "n_tokens", "over_limit").collect(), want)
    assert set(docs.columns) <= set(out.columns)
    assert token_counts.token_counts(empty, tokenizer(PIECES_MODEL)).count() == 0


def test_long_texts_split_exactly():
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=tokenizer(PIECES_MODEL))
    rng = random.Random(1)
    for _ in range(50):
        text = "".join(rng.choice("ab  é▁\n.xyz") for _ in range(400))
        parts = list(token_counts._pieces(text, 20))
        assert sum(len(model.encode(p)) for p in parts) == len(model.encode(text))


def license_by_hand(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = [(i, label) for p, label in license_scan.PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    at = [i for i, _ in places]
    return len(words), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def test_license_scan(docs, rows, empty):
    out = license_scan.license_scan(docs).collect()
    same([r[:6] for r in out], [(r[0], *license_by_hand(r[1])) for r in rows])
    labels = {r["doc_id"]: r for r in out}
    assert "gpl" in labels[21]["labels"].split(",") and labels[21]["score"] == 1.0
    assert all(0 <= r["score"] <= 1 and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) for r in out)
    assert license_scan.license_scan(empty).count() == 0


def test_automaton_matches_by_hand():
    rng = random.Random(3)
    for _ in range(100):
        templates = {str(k): " ".join(rng.choice("abc") for _ in range(rng.randint(5, 14))) for k in range(3)}
        phrases = {" ".join(rng.choice("abc") for _ in range(3)): str(k) for k in range(3)}
        a = license_scan.Automaton(phrases, templates)
        text = [rng.choice("abcd") for _ in range(60)]
        all_ = [t.split() for t in [*templates.values(), *phrases]]
        state = matched = 0
        hits = 0
        for i, w in enumerate(text):
            state, matched = a.step(state, matched, a.ids.get(w.encode(), -1))
            longest = max((n for n in range(1, i + 2) for t in all_ for k in range(len(t) - n + 1) if t[k : k + n] == text[i + 1 - n : i + 1]), default=0)
            assert matched == longest
            hits += sum(n <= matched for n, _ in a.found[state])
        assert hits == sum(text[i : i + 3] == p.split() for p in phrases for i in range(len(text) - 2))
        assert license_scan.scan_text(a, " ".join(text).encode())[1] == hits


def test_pieces_and_packing(docs, rows, empty):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer(WORDS_MODEL))
    want = []
    for r in rows:
        ids = [*library.encode(r[1] or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 4096):
            part = ids[k : k + 4096]
            want.append((r[0], k // 4096, k, len(part), zlib.crc32(array("I", part).tobytes())))
    out = packing.pack_documents(docs, tokenizer(WORDS_MODEL)).collect()
    same([r[:5] for r in out], want)
    by = {}
    for r in out:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096
    ids = packing.pieces(docs, tokenizer(WORDS_MODEL), with_ids=True).collect()
    assert all(len(r["ids"]) == r["length"] for r in ids)
    assert packing.pack_documents(empty, tokenizer(WORDS_MODEL)).count() == 0


def _optimum(sizes, capacity):
    best = [len(sizes)]

    def go(k, rooms):
        if len(rooms) >= best[0]:
            return
        if k == len(sizes):
            best[0] = len(rooms)
            return
        for i in {r: i for i, r in enumerate(rooms) if r >= sizes[k]}.values():
            go(k + 1, [*rooms[:i], rooms[i] - sizes[k], *rooms[i + 1 :]])
        go(k + 1, [*rooms, capacity - sizes[k]])

    sizes = sorted(sizes, reverse=True)
    go(0, [])
    return best[0]


def test_reduction_keeps_an_optimal_packing():
    rng = random.Random(2)
    for _ in range(200):
        capacity = rng.choice([10, 20, 33])
        sizes = [rng.randint(1, capacity) for _ in range(rng.randint(0, 10))]
        count = np.bincount(sizes, minlength=capacity + 1)
        fixed = packing.dominance_reduction(count, capacity)
        left = [s for s in range(capacity + 1) for _ in range(count[s])]
        assert sorted([s for p, n in fixed for s, each in p for _ in range(each * n)] + left) == sorted(sizes)
        assert all(sum(s * each for s, each in p) <= capacity for p, _ in fixed)
        assert sum(n for _, n in fixed) + _optimum(left, capacity) == _optimum(sizes, capacity)
        rest = packing.best_fit(count, capacity)
        assert sorted(s for p, n in rest for s, each in p for _ in range(each * n)) == left
        assert all(sum(s * each for s, each in p) <= capacity for p, _ in rest)


def shingles(text, n=5):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < n:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def near_by_hand(rows, percent=85):
    sets = [shingles(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            inter = len(sets[i] & sets[j])
            same_id = rows[i][0] is not None and rows[i][0] == rows[j][0]
            if sets[i] and sets[j] and (100 * inter >= percent * (len(sets[i]) + len(sets[j]) - inter) or same_id):
                parent[root(i)] = root(j)
    groups = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            groups[root(i)] = min(groups.get(root(i), r[0]), r[0])
    out = []
    for i, r in enumerate(rows):
        component = groups.get(root(i)) if sets[i] else r[0]
        out.append((r[0], len(sets[i]), component, r[0] == component))
    return out


def test_near_duplicates(spark, docs, rows, empty):
    same(near_dup.near_duplicates(docs).collect(), near_by_hand(rows))
    assert near_dup.near_duplicates(empty).count() == 0


def test_near_duplicates_in_chains_and_large_groups(spark):
    rng = random.Random(8)
    rows, k = [], 0
    for _ in range(3):
        words = [f"w{rng.randint(0, 900)}" for _ in range(150)]
        for _ in range(70):  # a drifting chain: its ends are far apart
            words = list(words)
            words[rng.randrange(150)] = f"n{k}"
            rows.append((k, " ".join(words)))
            k += 1
    passage = [f"p{i}" for i in range(60)]
    for _ in range(60):  # one passage shared by documents that stay apart
        rows.append((k, " ".join(passage + [f"q{rng.randint(0, 99999)}" for _ in range(25)])))
        k += 1
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    same(near_dup.near_duplicates(frame).collect(), near_by_hand(rows))


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300) if i != 150], "u long, v long")
    labels = dict(near_dup.components(edges).collect())
    assert all(labels.get(i, i) == (0 if i <= 150 else 151) for i in range(301))


def lm_by_hand(rows):
    words = [WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), r[1] or "")) for r in rows]
    out = [r[0] is None or zlib.crc32(str(r[0]).encode()) % 5 == 1 for r in rows]
    counts, ends = Counter(), 0
    for w, o in zip(words, out, strict=True):
        if not o:
            counts.update(w)
            ends += 1
    n, v = sum(counts.values()) + ends, len(counts) + 1
    value = lambda c: math.log10((c + 0.5) / (n + 0.5 * (v + 1)))
    return [(r[0], o, len(w) + 1, sum(counts[x] > 0 for x in w) + 1, n, round(sum(value(counts[x]) for x in w) + value(ends), 6)) for r, o, w in zip(rows, out, words, strict=True)]


@pytest.mark.parametrize("heavy", [1 << 20, 40])
def test_lm_base_scores(docs, rows, heavy):
    out = lm_score.lm_scores(docs, tokenizer(PIECES_MODEL), heavy=heavy).collect()
    same([(*r[:5], round(r[5], 6)) for r in out], lm_by_hand(rows))
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in out)


def test_lm_empty(empty):
    assert lm_score.lm_scores(empty, tokenizer(PIECES_MODEL)).count() == 0


def test_long_words_sum_like_short_ones(monkeypatch):
    rng = np.random.default_rng(1)
    pieces = [b" ", b"a", b"b", b"ab", b" a", b"ba", b"bab"]
    lattice = lm_score.Lattice(pieces, np.log(rng.dirichlet(np.ones(len(pieces)))))
    words = [b" " + bytes(rng.choice(list(b"ab"), n).tolist()) for n in (1, 5, 40, 200)]
    at = np.concatenate([[0], np.cumsum([len(w) for w in words])])
    data = np.frombuffer(b"".join(words), np.uint8)
    short = lattice.log_marginals(data, at), lattice.expected(data, at, np.arange(1, 5))
    monkeypatch.setattr(lm_score, "LONG_WORD", 0)
    assert np.allclose(short[0], lattice.log_marginals(data, at)) and np.allclose(short[1], lattice.expected(data, at, np.arange(1, 5)))


def test_lattice_sums_all_segmentations():
    pieces = [b" ", b"a", b"b", b"ab", b" a", b"ba", b" ab", b"bab"]
    logs = np.log(np.random.default_rng(0).dirichlet(np.ones(len(pieces))))
    p = dict(zip(pieces, np.exp(logs), strict=True))
    lattice = lm_score.Lattice(pieces, logs)

    def paths(w):
        if not w:
            yield ()
        for x in pieces:
            if w.startswith(x):
                yield from ((x, *rest) for rest in paths(w[len(x) :]))

    words = [b" a", b" abab", b" bab", b" babab", b" b"]
    at = np.concatenate([[0], np.cumsum([len(w) for w in words])])
    data = np.frombuffer(b"".join(words), np.uint8)
    totals = [sum(math.prod(p[x] for x in path) for path in paths(w)) for w in words]
    assert np.allclose(lattice.log_marginals(data, at), np.log(totals))
    want = Counter()
    for w, t, c in zip(words, totals, range(1, 6), strict=True):
        for path in paths(w):
            for x in path:
                want[x] += c * math.prod(p[y] for y in path) / t
    assert np.allclose(lattice.expected(data, at, np.arange(1, 6)), [want[x] for x in pieces])


def quality_by_hand(text):
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    times = Counter(zip(words, words[1:], words[2:], strict=False))
    again = {i + k for i in range(len(words) - 2) if times[tuple(words[i : i + 3])] > 1 for k in range(3)}
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(again), n < 50 or 100 * len(again) > 50 * n


def test_quality(docs, rows, empty):
    out = quality.quality(docs).collect()
    same([r[:7] for r in out], [(r[0], *quality_by_hand(r[1])) for r in rows])
    assert all(not (r["base_failed"] and r["kept"]) for r in out)
    assert quality.quality(empty).count() == 0
    carried = quality.quality(docs, carry=True)
    assert set(docs.columns) - {"n_words", "kept"} <= set(carried.columns) and carried.count() == len(rows)


def test_quality_of_rare_languages(spark, monkeypatch):
    rng = random.Random(3)

    def text(letters, n):
        common, other = [["".join(rng.choice(letters) for _ in range(k)) for _ in range(m)] for k, m in ((3, 20), (8, 2000))]
        return [" ".join(rng.choice(common if rng.random() < 0.45 else other) for _ in range(150)) for _ in range(n)]

    english, greek, russian = text("abcdefghij", 300), text("αβγδεζηθικ", 2), text("абвгдежзий", 2)
    junk = " ".join("".join(rng.choice("0123456789#") for _ in range(9)) for _ in range(150))
    data = [(i, t, lang) for i, (t, lang) in enumerate([*((t, "en") for t in english), *((t, "el") for t in greek), *((t, "ru") for t in russian), (greek[0], None), (russian[0], " "), (junk, "en")])]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string")

    def judged(most):
        monkeypatch.setattr(quality, "MAX_LANGS", most)
        return sorted(quality.quality(docs).collect())

    out = judged(100)  # el and ru have fewer than one in 100 of all words
    assert [r["kept"] for r in out] == [True] * (len(data) - 1) + [False]
    assert [r["doc_id"] for r in out if r["class_distance"] is None] == [len(data) - 3, len(data) - 2] == [r["doc_id"] for r in out if r["word_distance"] is None]
    assert out == judged(10**6)  # all references broadcast: shares make no difference
    carried = quality.quality(docs.withColumn("kept", F.lit(1)), carry=True).where("lang = 'el'").collect()
    assert [(r["lang"], r["kept"]) for r in carried] == [("el", True)] * 2


def test_distance_by_hand():
    p, q = np.array([[0.5, 0.5, 0.0]]), np.array([0.0, 0.5, 0.5])
    m = (p[0] + q) / 2
    kl = lambda a: sum(x * math.log2(x / y) for x, y in zip(a, m, strict=True) if x)
    assert quality.distance(p, q)[0] == pytest.approx(math.sqrt((kl(p[0]) + kl(q)) / 2))
    assert quality.distance(np.array([[1.0, 0.0]]), np.array([0.0, 1.0]))[0] == pytest.approx(1)


def removed_by_hand(rows, length=50):
    low = {}
    texts = [(r[0], (r[1] or "").encode()) for r in rows]
    for d, t in texts:
        if d is not None:
            for i in range(len(t) - length + 1):
                low[t[i : i + length]] = min(low.get(t[i : i + length], d), d)
    out = []
    for d, t in texts:
        gone = bytearray(len(t))
        if d is not None:
            for i in range(len(t) - length + 1):
                if low[t[i : i + length]] < d:
                    gone[i : i + length] = b"\x01" * length
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        out.append((d, len(t), sum(gone), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("hot_rows", [8192, 1])
def test_remove_repeats(docs, rows, empty, hot_rows):
    same(suffix_dedup.remove_repeats(docs, hot_rows=hot_rows).collect(), removed_by_hand(rows))
    assert suffix_dedup.remove_repeats(empty).count() == 0


@pytest.mark.parametrize("hot_rows", [8192, 2])
def test_remove_repeats_of_random_passages(spark, hot_rows):
    rng = random.Random(4)
    passages = ["".join(rng.choice("abcdefgh é") for _ in range(rng.choice([49, 50, 51, 90, 300]))) for _ in range(12)]
    rows = [(i, "".join(rng.choice(passages) if rng.random() < 0.5 else "".join(rng.choice("abcdefgh ") for _ in range(rng.randint(0, 80))) for _ in range(6))) for i in range(60)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    same(suffix_dedup.remove_repeats(frame, hot_rows=hot_rows).collect(), removed_by_hand(rows))


def test_suffix_array_is_sorted():
    rng = random.Random(1)
    for _ in range(200):
        parts = [bytes(rng.choice(b"ab\x00c"[: rng.randint(1, 4)]) for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(1, 6))]
        text = np.concatenate([np.append(np.frombuffer(p, np.uint8).astype(np.int16) + 1, 0) for p in parts]).astype(np.int16)
        ends = np.flatnonzero(text == 0)
        order = suffix_dedup.suffix_array(text)
        suffixes = [text[i : ends[np.searchsorted(ends, i)]].tolist() for i in order]
        assert sorted(order.tolist()) == list(range(len(text))) and suffixes == sorted(suffixes)


def top_by_hand(rows, every, k):
    sound = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    queries = {}
    for i, v in sound:
        if i % every == 0:
            queries[i] = min(queries.get(i, v), v)
    out = []
    for q, v in queries.items():
        scores = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), i) for i, w in sound if i != q)[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores)]
    return out


@pytest.mark.parametrize("scale", [1.0, 1e-3, 3e4])
def test_top_k(spark, scale):
    rng = random.Random(9)
    rows = [(i, [float(np.float32(rng.gauss(0, scale))) for _ in range(16)]) for i in range(700)]
    rows += [(700, None), (701, [1.0, None]), (702, [float("nan")] * 16), (703, [float("inf")] * 16), (None, [1.0]), (704, []), (705, [1.0, 2.0]), rows[3], rows[20], rows[20]]
    rows += [(710 + i, rows[3][1]) for i in range(30)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    same(topk.top_k(frame, every=20).collect(), top_by_hand(rows, 20, 10))
    assert topk.top_k(frame.limit(0)).count() == 0
    assert topk.top_k(frame.where("vec_id % 100 > 0")).count() == 0
    assert topk.top_k(frame.where("vec_id = 0")).count() == 0


def test_top_k_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_ROWS", 50)
    monkeypatch.setattr(topk, "QUERY_ROWS", 7)
    rng = random.Random(10)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(400)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    same(topk.top_k(frame, every=10, k=5).collect(), top_by_hand(rows, 10, 5))


def test_mixing(docs, rows, empty):
    out = mixing.mix_sources(docs).collect()
    size = lambda t: len(WORD.findall(t or ""))
    assert Counter((r["doc_id"], r["size"]) for r in out) == Counter((r[0], size(r[1])) for r in rows)
    of = {}
    for r in rows:
        of[r[3]] = of.get(r[3], 0) + size(r[1])
    total, left, stopped = sum(of.values()), sum(of.values()), {}
    weights = dict(zip(sorted(of, key=lambda s: (s is None, s or "")), (5, 2, 1, 5), strict=False))
    while over := [s for s in of if s not in stopped and left * weights[s] / sum(w for x, w in weights.items() if x not in stopped) > 3 * of[s]]:
        for s in over:
            stopped[s] = 3 * of[s]
        left = total - sum(stopped.values())
    free = sum(w for x, w in weights.items() if x not in stopped)
    target = {s: stopped.get(s, left * weights[s] / free if free else 0) for s in of}
    by_size = {of[s]: target[s] for s in of}
    assert all(r["target"] == pytest.approx(by_size[r["source_size"]]) for r in out)
    for s in of:
        assert sum(r["taken"] for r in out if r["source_size"] == of[s]) == math.floor(target[s] + 1e-9)
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in out)
    same([tuple(r) for r in mixing.mix_sources(docs.repartition(7), range_rows=3).collect()], [tuple(r) for r in out])
    assert mixing.mix_sources(empty).count() == 0


def test_chat(spark):
    turns = [
        (1, "chosen", 0, "user", "hi"), (1, "chosen", 1, "assistant", "a"), (1, "chosen", 2, "user", "é?"), (1, "chosen", 3, "assistant", "yes"),
        (1, "rejected", 0, "user", "hi"), (1, "rejected", 1, "assistant", "a"), (1, "rejected", 2, "user", "é?"), (1, "rejected", 3, "assistant", None),
        (2, "chosen", 0, "user", "x"), (2, "rejected", 0, "user", "x"),
        (3, "chosen", 5, None, "only"),
        (4, "chosen", 0, "user", "x"), (4, "chosen", 0, "user", "x"), (4, "chosen", 1, "assistant", "y"), (4, "rejected", 0, "user", "x"),
    ]
    out = {r["pair_id"]: r for r in chat.preference_pairs(spark.createDataFrame(turns, "pair_id long, side string, turn long, role string, text string")).collect()}
    assert out[1]["n_prompt_turns"] == 3 and out[1]["prompt"] == "<|user|>\nhi<|end|>\n<|assistant|>\na<|end|>\n<|user|>\né?<|end|>\n"
    assert out[1]["chosen"] == "<|assistant|>\nyes<|end|>\n" and out[1]["chosen_mask"] == "14-17" and out[1]["rejected_mask"] == "14-14" and out[1]["usable"]
    assert out[1]["chosen"][14:17] == "yes"
    assert out[2]["n_prompt_turns"] == 1 and out[2]["chosen"] == "" and not out[2]["usable"]
    assert out[3]["rejected"] is None and out[3]["chosen"] == "<|unknown|>\nonly<|end|>\n" and out[3]["prompt"] == ""
    assert out[4]["n_prompt_turns"] == 1 and out[4]["chosen_mask"] == "14-15" and not out[4]["usable"]


def test_native_plans_hold_no_python(docs, spark):
    turns = spark.createDataFrame([(0, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    for frame in (mixing.mix_sources(docs), chat.preference_pairs(chat.paired(turns))):
        assert not re.search("Python|Pandas|Arrow", frame._jdf.queryExecution().toString())


def test_nothing_is_left_of_the_text_column(docs):
    kept = suffix_dedup.remove_repeats(docs, with_text=True)
    assert {"kept", "lang", "source"} <= set(kept.columns) and kept.where(F.col("kept").isNull()).count() == 0


def test_near_duplicates_of_repeated_and_missing_ids(spark):
    words = [f"w{i}" for i in range(100)]
    rows = [(1, " ".join(words)), (1, " ".join(f"x{i}" for i in range(400))), (2, " ".join([*words[:96], "k1", "k2"]))]
    rows += [(7, " ".join(f"x{i}" for i in range(398))), (None, " ".join([*words[:97], "k3"])), (None, "alone"), (None, None), (None, None), (9, "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    same(near_dup.near_duplicates(frame).collect(), near_by_hand(rows))
    numbered = frame.withColumn("row", F.monotonically_increasing_id())
    single = [r["doc_id"] for r in near_dup.near_duplicates(numbered, row="row").where("single").collect()]
    assert sorted(single, key=str) == [1, 9, None, None, None]  # one row of each component, and all without words


def test_near_duplicates_of_many_edits(spark):
    """Copies with one to five edits from few words: links run across edits, and the pivot has not all of them."""
    rng = random.Random(12)
    base = [f"b{i}" for i in range(110)]
    rows = []
    for k in range(260):
        words = list(base)
        for _ in range(rng.randint(1, 5)):
            words[rng.randrange(110)] = f"e{rng.randrange(6)}"
        rows.append((k, " ".join(words)))
    same(near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect(), near_by_hand(rows))


def quality_whole_by_hand(rows):
    """kept, class_distance and word_distance of (doc_id, text, lang), from references counted in plain Python."""
    def classes(text):
        out = Counter()
        for c in text:
            kinds = [c in "abcdefghijklmnopqrstuvwxyz", c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ", c in "0123456789", c in "\t\x0b\x0c\r ", c == "\n", c in ".,;:!?'\"()-", c in "#*$%&|<>"]
            out[kinds.index(True) if any(kinds) else 7 if ord(c) < 128 else 8] += 1
        return out

    def distance(p, q):
        keys = set(p) | set(q)
        p, q = ({k: x[k] / max(sum(x.values()), 1) for k in keys} for x in (p, q))
        kl = lambda a: sum(a[k] * math.log2(2 * a[k] / (p[k] + q[k])) for k in keys if a[k])
        return math.sqrt(max(0, (kl(p) + kl(q)) / 2))

    refs = {}
    for _, text, lang in rows:
        c, w = refs.setdefault(lang, (Counter(), Counter()))
        c.update(classes(text))
        w.update(WORD.findall(text))
    out = []
    for doc, text, lang in rows:
        if lang is None:
            out.append((doc, not quality_by_hand(text)[5], None, None))
            continue
        c, w = refs[lang]
        common = {x for x, _ in w.most_common(64)}
        told = lambda words: Counter({k: n for k, n in words.items() if k in common} | {None: sum(n for k, n in words.items() if k not in common)})
        far = distance(classes(text), c), distance(told(Counter(WORD.findall(text))), told(w))
        n, failed = quality_by_hand(text)[0], quality_by_hand(text)[5]
        out.append((doc, not failed and (n < 100 or far[0] <= quality.MAX_CLASS and far[1] <= quality.MAX_WORDS), *(round(x, 9) for x in far)))
    return out


def test_quality_whole_rows_by_hand(spark):
    rng = random.Random(21)
    rows = []
    for lang, letters in (("en", "abcdefghijkl"), ("el", "αβγδεζηθ")):
        vocabulary = ["".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) + str(i) for i in range(150)]
        for i in range(60):
            text = " ".join(rng.choices(vocabulary, [1 / (k + 1) for k in range(150)], k=rng.choice([30, 80, 130, 200])))
            rows.append((len(rows), rng.choice([text, text.upper() + "\n#$ 12.", text]), lang))
        rows.append((len(rows), " ".join(f"{rng.random():.9f}#" for _ in range(150)), lang))
        rows.append((len(rows), " ".join(f"{letters[:3]}{i}" for i in range(150)), lang))
    # the 64th and 65th word of a language must not tie: one more of each word, as often as its place says
    for lang in ("en", "el"):
        words = Counter(w for _, t, x in rows if x == lang for w in WORD.findall(t)).most_common(70)
        rows.append((len(rows), " ".join(w for k, (w, _) in enumerate(words) for _ in range(2 * (70 - k))), lang))
    rows.append((len(rows), rows[0][1], None))
    out = quality.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    found = [(r["doc_id"], r["kept"], *(None if x is None else round(x, 9) for x in (r["class_distance"], r["word_distance"]))) for r in out]
    same(found, quality_whole_by_hand(rows))
    assert {r["kept"] for r in out if not r["base_failed"]} == {True, False}


def test_license_phrases_of_any_length(spark):
    texts = ["it is public domain now", "a cc0 work", "public", "Public Domain", None, "x " * 30 + "cc0 " + "y " * 30]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r["doc_id"]: r for r in license_scan.license_scan(docs, {"public domain": "pd", "cc0": "cc0"}, {}).collect()}
    assert [(out[i]["n_base"], out[i]["first_word"], out[i]["labels"]) for i in range(6)] == [(1, 2, "pd"), (1, 1, "cc0"), (0, None, ""), (1, 0, "pd"), (0, None, ""), (1, 30, "cc0")]


def test_license_whole_rows_by_hand(spark):
    """labels, score and spans against chains found by comparing all positions of texts and templates."""
    rng = random.Random(30)
    names = [f"t{k}" for k in range(4)]
    templates = {f"{n}/x" if k % 2 else n: " ".join(f"w{k}x{i}" for i in range(20)) for k, n in enumerate(names)}
    size, texts, want = 20, [], []
    for _ in range(40):
        k, (a, b), gap = rng.randrange(4), sorted(rng.sample(range(21), 2)), rng.choice([0, 3, 12, 13])
        words = [f"w{k}x{i}" for i in range(20)]
        cut = rng.randint(a, b)
        text = ["pad", *words[a:cut], *["other"] * gap, *words[cut:b], "pad"]
        runs = [(1, cut - a), (1 + cut - a + gap, b - cut)] if gap else [(1, b - a)]
        runs = [(begin, n) for begin, n in runs if n >= 5]
        chains = [(n, begin, begin + n) for begin, n in runs]
        if len(runs) == 2 and gap <= 12:
            chains = [(runs[0][1] + runs[1][1], runs[0][0], runs[1][0] + runs[1][1])]
        best = max(chains, key=lambda c: c[0], default=None)
        texts.append(" ".join(text))
        want.append((names[k] if best and best[0] / size >= 0.6 else "", best[0] / size if best else 0.0, best and best[1:]))
    out = sorted(license_scan.license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), {}, templates).collect())
    found = [(r["labels"], r["score"], (r["spans"][0]["start"], r["spans"][0]["end"]) if r["spans"] else None) for r in out]
    assert [f[:2] for f in found] == [w[:2] for w in want]
    assert all(f[2] == w[2] for f, w, in zip(found, want, strict=True))


def test_preference_turns_without_number_and_long(spark):
    long = "word " * 300_000
    rows = [(1, "chosen", 0, "user", "hi"), (1, "rejected", 0, "user", "hi"), (1, "chosen", None, "assistant", "late"), (1, "chosen", 1, "assistant", long), (1, "rejected", 1, None, None), (None, "chosen", 0, "user", "x"), (2, "rejected", 5, "user", "only")]
    schema = "pair_id long, side string, turn int, role string, text string, prompt string"
    out = {r["pair_id"]: r for r in chat.preference_pairs(spark.createDataFrame([(*r, "clash") for r in rows], schema)).collect()}
    assert set(out) == {1, 2, None} and out[1]["n_prompt_turns"] == 1
    assert out[1]["chosen"].endswith("<|assistant|>\nlate<|end|>\n") and long in out[1]["chosen"]
    assert out[1]["rejected"] == "<|unknown|>\n<|end|>\n" and not out[1]["usable"] and out[2]["chosen"] is None
    assert chat.preference_pairs(spark.createDataFrame([], schema)).count() == 0


@pytest.mark.parametrize("sizes", [(16, 2, 3), (8, 256, 65536)])
def test_topk_of_small_blocks_and_parts(spark, monkeypatch, sizes):
    for name, size in zip(("BLOCK_ROWS", "FIRST_QUERIES", "PART_QUERIES"), sizes, strict=True):
        monkeypatch.setattr(topk, name, size)
    rng = np.random.default_rng(17)
    rows = [(i, [float(x) for x in rng.normal(size=rng.choice([0, 3, 12])) * rng.choice([1, 1e-3, 40])]) for i in range(150)]
    rows += [(150, [0.5] * 12), (152, [0.5] * 12), (154, [0.5] * 12)]  # ties
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    same(topk.top_k(frame, every=5, k=4).collect(), top_by_hand(rows, 5, 4))
