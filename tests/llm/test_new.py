"""HTML extraction, the Merkle manifest and vector codes against brute force and literal cases."""

import hashlib
import random
import zlib
from math import floor, inf, log, nan

import numpy as np
import pytest
from pyspark.sql import functions as F

from phenolith.llm import html_extract, merkle, vector_codes

PAGES = "page_id long, url string, html string, text int, file string, node long"


def text_of(source):
    return html_extract.Page(source).main_text({}, {}, "h")


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("", ""),
        ("  \n ", ""),
        ("plain &amp; <i>sim</i>ple &lt;p&gt; &am", "plain & simple <p> &am"),
        ("<p>one<p>two<br>three&nbsp;four\n\n five", "one two three four five"),
        ('<head><title>t<b></title><script>"</p>"</script><style>p{}</style></head><p>a<!-- no <p>b --><p>c', "a c"),
        ("<nav>menu</nav><article><h1>T</h1><p>a</p><aside>s</aside><footer>by</footer></article><footer>f", "T a"),
        ('<div class="sidebar"><article>teaser</article></div><main><h1>T</h1><article class="post comments-open"><p>a</p></article></main><article class="comment">c</article>', "T a"),
        ('<body class="has-sidebar"><div class="site-header">s</div><div class="with-ads"><h1>T</h1><p>the text of this page</p></div><div id="comments">c</div></body>', "T the text of this page"),
        ('<form id="all"><div><h1>T</h1><p>most of the text is in here</p><input name="q"></div></form><form>find</form>', "T most of the text is in here"),
        ('<article>a <span class="ad">buy</span> b <span hidden>no</span><b>c</b><div style="display: none">d</div><p role="alert">e</p><noscript>f</noscript>g</article>', "a b c g"),
        ("<table><tr><td>a<td>b<tr><td>c</table>d</div> e<ul><li>f<li>g<ul><li>h</ul><li>i</ul>", "a b c d e f g h i"),
        ("<p><b>open <p>on <i>and</b> on</i> <a href='x'>link</a>", "open on and on link"),
        ("a < b <", "a < b <"),
        ("text <a href='cut", "text"),
        ("<div>" * 3000 + "deep" + "</div>" * 3000 + "<script>never closed", "deep"),
    ],
)
def test_pages(source, want):
    assert text_of(source) == want


def site(spark, pages):
    rows = [(i, u, h, 1, "clash", 2) for i, (u, h) in enumerate(pages)]
    return {r["page_id"]: r["text"] for r in html_extract.extract_text(spark.createDataFrame(rows, PAGES).repartition(3)).collect()}


def test_style_tree_removes_what_a_host_repeats(spark):
    """Without declared parts, blocks that a host's pages repeat go, and so do branches made of links; other hosts do not count."""
    own = [f"Page {w} tells of {w} and of nothing else." for w in "red green blue white black pink grey brown gold lime".split()]
    page = "<div class=x1><a href=/a>Home</a> <a href=/b>All</a></div><div class=x2><h1>{0}</h1><p>{1}</p></div><div class=x3>Write to us.</div>"
    a = [("http://www.a.com/p", page.format(f"T{i}", t)) for i, t in enumerate(own)]
    found = site(spark, [*a, ("http://b.com/1", page.format("T0", own[0])), ("https://b.com/2", page.format("T0", own[0])), (None, "<p>x"), (None, None), ("u", "")])
    for i, t in enumerate(own):
        assert found[i] == f"T{i} {t}"
    assert found[10] == found[11] == f"T0 {own[0]} Write to us."  # all that two equal pages have, links aside
    assert (found[12], found[13], found[14]) == ("x", "", "")


def test_articles_keep_what_they_share(spark):
    """Copies of an article stay whole; only what nearly all articles of a host hold besides their own text goes."""
    copies = [("http://c.com/", "<nav>m</nav><article><h1>Same</h1><p>The same text everywhere.</p></article>")] * 12
    shared = [(f"http://d.com/{i}", f"<article><p>Own text number {w} is long enough to stand alone.</p><p>Share this.</p></article>") for i, w in enumerate("abcdefghijkl")]
    found = site(spark, copies + shared)
    assert {found[i] for i in range(12)} == {"Same The same text everywhere."}
    assert found[12] == "Own text number a is long enough to stand alone."


def test_tree_against_brute_force(spark):
    pages = [("http://e.com/", f"<div class='a{i}'><p>{'xyz'[i % 3]}</p>{'<ul><li>1</ul>' * (i % 2)}</div><p>{'same' if i % 4 else 'other'}") for i in range(9)]
    df = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(pages)], "row long, url string, html string")
    parsed = html_extract.parsed(df.select(F.lit(0).cast("long"), "row", "url", "html")).cache()
    styles, texts = {}, {}
    for u, h in pages:
        page = html_extract.Page(h)
        page.settle()
        keys, own = page.nodes("e.com")
        for k, s in own.items():
            styles.setdefault(k, []).append(s)
        for t in set(page.features(keys)):
            texts[t] = texts.get(t, 0) + 1
    found = {r["node"]: r for r in html_extract.style_tree(parsed).collect()}
    assert set(found) == set(styles) and len(found) == 6
    for k, seen in styles.items():
        m = len(seen)
        entropy = -sum(seen.count(s) / m * log(seen.count(s) / m, m) for s in set(seen)) if m > 1 else 1
        assert (found[k]["pages"], found[k]["styles"]) == (m, len(set(seen))) and abs(found[k]["importance"] - entropy) < 1e-9
    assert {r["text"]: r["seen"] for r in html_extract.repeated_texts(parsed).collect()} == {t: n for t, n in texts.items() if n > 1}


def test_no_pages(spark):
    out = html_extract.extract_text(spark.createDataFrame([], PAGES))
    assert out.columns == ["page_id", "url", "text", "n_chars"] and out.count() == 0


DOCS = "doc_id long, source string, lang string, n_chars long, text string, g string, pos long, digest int"


def h(*values):
    return hashlib.sha256("".join(values).encode()).hexdigest()


def folded(nodes, run):
    """Root of the nodes and the siblings (left, right) of each, level by level."""
    sides = [[] for _ in nodes]
    at = list(range(len(nodes)))
    while len(nodes) > 1:
        for i, p in enumerate(at):
            first = p - p % run
            sides[i].append(("".join(nodes[first:p]), "".join(nodes[p + 1 : first + run])))
            at[i] = p // run
        nodes = [h(*nodes[i : i + run]) for i in range(0, len(nodes), run)]
    return (nodes or [None])[0], sides


def manifest(rows, run):
    value = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    made = []
    for d, source, lang, n, text, *_ in rows:
        leaf = h(*map(value, (d, source, lang, n, text)))
        other = leaf
        if d is not None and zlib.crc32(str(d).encode()) % 5 == 0:
            other = h(*map(value, (d, source, lang, n, text and text.translate(low))))
        made.append((source, d, leaf, other))
    by = {}
    for m in made:
        by.setdefault(m[0], []).append(m)
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in order:
        by[s].sort(key=lambda m: (m[1] is not None, m[1] or 0, m[2]))
    trees = {s: folded([m[2] for m in by[s]], run) for s in order}
    root, above = folded([trees[s][0] for s in order], run)
    out = []
    for k, s in enumerate(order):
        for m, sides in zip(by[s], trees[s][1], strict=True):
            steps, value_ = sides + above[k], m[3]
            for a, b in steps:
                value_ = h(a, value_, b)
            out.append((m[1], m[2], trees[s][0], root, h(*(x for pair in steps for x in pair)), value_, value_ == root))
    return out


@pytest.mark.parametrize(("run", "stride"), [(16, 3), (2, 2), (3, 1), (2, 3)])
def test_merkle(spark, run, stride):
    rng = random.Random(run)
    rows = [(i if rng.random() < 0.95 else None, rng.choice(["b", "b", "b", "a", "é", None, "", "zz"]), rng.choice(["en", None]), i % 5 or None, rng.choice(["Text A", "", None, "é\x00ß" * 50, "low"]), "clash", 1, 2) for i in range(150)]
    rows += rows[:3] + [(7, "single", None, None, "x" * 100_000, "", 0, 0)]
    found = merkle.merkle_manifest(spark.createDataFrame(rows, DOCS).repartition(3), run, stride, siblings=True).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(((r["doc_id"], r["leaf"], r["subroot"], r["root"], r["proof_sha256"], r["folded_root"], r["verified"]) for r in found), key=key) == sorted(manifest(rows, run), key=key)
    assert all(h(*r["siblings"]) == r["proof_sha256"] for r in found)
    assert {r["verified"] for r in found} == {True, False}


def test_merkle_of_nothing_and_of_one(spark):
    assert merkle.merkle_manifest(spark.createDataFrame([], DOCS)).count() == 0
    row = merkle.merkle_manifest(spark.createDataFrame([(None, None, None, None, None, "", 0, 0)], DOCS)).first()
    assert row["leaf"] == row["subroot"] == row["root"] == h("-----") and row["verified"] and row["proof_sha256"] == h("")


VECTORS = "vec_id long, embedding array<float>, label int, code string, ids int"


def codes(rows, parts, entries, rounds):
    kept = [(v, tuple(floor(1024 * float(np.float32(c))) for c in x), lab) for v, x, lab, *_ in rows if x is not None and all(c is not None and abs(c) < inf for c in x)]
    width = len(kept[0][1]) // parts
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[r[1][p * width : (p + 1) * width] for r in first] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda x, book: min((far(x, c), i) for i, c in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            own = {}
            for r in kept:
                x = r[1][p * width : (p + 1) * width]
                own.setdefault(near(x, books[p])[1], []).append(x)
            for i, xs in own.items():
                books[p][i] = tuple(sum(c) // len(xs) for c in zip(*xs, strict=True))
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    out = []
    for v, x, lab in kept:
        best = [near(x[p * width : (p + 1) * width], books[p]) for p in range(parts)]
        out.append((v, "".join(f"{i:02x}" for _, i in best), sum(d for d, _ in best), lab))
    sums = {}
    for r in out:
        sums[r[3]] = sums.get(r[3], 0) + r[2]
    return [(v, c, e, sums[lab], digest) for v, c, e, lab in out]


@pytest.mark.parametrize(("n", "entries", "parts", "dim"), [(300, 20, 4, 8), (9, 256, 2, 6), (120, 5, 1, 1)])
def test_vector_codes(spark, n, entries, parts, dim):
    rng = random.Random(n)
    grid = [round(rng.uniform(-2, 2), 1) for _ in range(7)]
    rows = [(rng.randint(0, 2 * n), [rng.choice(grid) for _ in range(dim)], rng.choice([1, 2, None]), "clash", 1) for _ in range(n)]
    rows += [rows[0], (None, rows[1][1], 3, "", 0), (5, None, 1, "", 0), (6, [nan] * dim, 1, "", 0), (7, [-inf] + [0.0] * (dim - 1), 1, "", 0), (8, [None] * dim, 1, "", 0)]
    found = vector_codes.vector_codes(spark.createDataFrame(rows, VECTORS).repartition(3), parts=parts, entries=entries, rounds=3, block=64)
    key = lambda r: tuple(map(str, r))
    assert sorted((tuple(r) for r in found.collect()), key=key) == sorted(codes(rows, parts, entries, 3), key=key)


def test_no_vectors(spark):
    for rows in ([], [(1, None, 1, "", 0)]):
        out = vector_codes.vector_codes(spark.createDataFrame(rows, VECTORS))
        assert out.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"] and out.count() == 0
    with pytest.raises(Exception, match="different lengths"):
        vector_codes.vector_codes(spark.createDataFrame([(1, [1.0] * 4, 1, "", 0), (2, [1.0] * 8, 1, "", 0)], VECTORS).coalesce(1)).count()


@pytest.mark.parametrize(("n", "k", "dim", "spread"), [(1, 1, 3, 5), (700, 64, 2, 4), (500, 256, 4, 2), (900, 33, 5, 10**6)])
def test_two_trees_are_exact(n, k, dim, spread):
    rng = np.random.default_rng(n)
    x, book = rng.integers(-spread, spread, (n, dim)), rng.integers(-spread, spread, (k, dim))
    if n == 900:  # tight clusters: whole nodes go to one entry
        x = np.repeat(rng.integers(-spread, spread, (9, dim)), 100, axis=0) + rng.integers(-2, 3, (n, dim))
    x = x[vector_codes.tree_order(x, vector_codes.depth_of(n))]
    found = vector_codes.Assignment(x, book)
    far = ((x[:, None, :] - book[None]) ** 2).sum(2)
    assert (found.entry == far.argmin(1)).all() and (found.error == far.min(1)).all()
    assert bool(found.whole) or n != 900
    count, total = found.sums(k)
    for e in range(k):
        own = x[far.argmin(1) == e]
        assert count[e] == len(own) and (total[e] == own.sum(0)).all()


def test_lm_scores_against_brute_force(spark):
    """The whole score of every text: fitted pieces, all segmentations, seen words and the end, all done again word by word."""
    import re
    from collections import Counter

    from phenolith.llm import lm_score
    from phenolith.llm.queries import PIECES_MODEL, tokenizer

    texts = ["The cat sat on the mat", "a cat, the Cat", None, "", "unseen wörds x1", "the the the mat", "zzqq the", "on on mat x1", "sat"]
    rows = list(enumerate(texts))
    found = {r["doc_id"]: r["score"] for r in lm_score.lm_scores(spark.createDataFrame(rows, "doc_id long, text string"), tokenizer(PIECES_MODEL)).collect()}
    words = {i: re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for i, t in rows}
    train = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 != 1]
    assert 0 < len(train) < len(rows)
    counts = Counter(w for i in train for w in words[i])
    n = sum(counts.values()) + len(train)
    fresh = (sum(c == 1 for c in counts.values()) + 1) / (n + 2)
    pieces, weights = lm_score.vocabulary(tokenizer(PIECES_MODEL))
    longest = max(map(len, pieces))

    def walk(text, p):
        """Sums over the segmentations of each prefix and suffix."""
        ahead, behind = [1.0] + [0.0] * len(text), [0.0] * len(text) + [1.0]
        for j in range(1, len(text) + 1):
            ahead[j] = sum(ahead[j - k] * p.get(text[j - k : j], 0.0) for k in range(1, min(longest, j) + 1))
        for j in range(len(text) - 1, -1, -1):
            behind[j] = sum(behind[j + k] * p.get(text[j : j + k], 0.0) for k in range(1, min(longest, len(text) - j) + 1))
        return ahead, behind

    total = float(weights.sum())
    p, end = {x: float(w) / (2 * total) for x, w in zip(pieces, weights, strict=True)}, 0.5
    for _ in range(lm_score.ROUNDS):
        expected = dict.fromkeys(pieces, lm_score.FLOOR)
        for w, c in counts.items():
            text = b" " + w.encode()
            ahead, behind = walk(text, p)
            mine = fresh * ahead[-1]
            times = c * (mine / (mine + (1 - fresh) * (c - 1) / n) if c > 1 else 1.0)
            for j in range(len(text)):
                for k in range(1, min(longest, len(text) - j) + 1):
                    x = text[j : j + k]
                    if x in p:
                        expected[x] += times * ahead[j] * p[x] * behind[j + k] / ahead[-1]
        total = sum(expected.values())
        p, end = {x: e / (total + 1) for x, e in expected.items()}, 1 / (total + 1)
    seen = (1 - fresh) / n
    for i, _ in rows:
        want = log(seen * len(train) + fresh * end, 10)
        for w in words[i]:
            want += log(seen * counts[w] + fresh * walk(b" " + w.encode(), p)[0][-1], 10)
        assert abs(found[i] - want) < 1e-6, (i, found[i], want)
