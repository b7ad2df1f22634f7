"""Main text of web pages by site style trees.

All pages of a host are merged into one tree. An element node stands for the elements with the same tags and classes
on the way to them; a style node for one sequence of children that an element has on some pages (runs of
the same child are one). A node's presentation is the more important the more its styles differ over the host's
pages, a text block the less the more pages repeat it in the same node; both are entropies with the number of
pages as base. Roles that markup declares (menus, footers, adverts, comments; articles and main parts) are
certain and set a branch's importance outright. Importance is carried up each page's own tree, and branches of low
importance are removed from it.

The trees are tables of counts by node and style and by node and text, joined back to the pages that need
them; no host is held anywhere as a whole.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from hashlib import blake2b
from math import log

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import placed_rows, written

#: A branch of lower importance goes: outside of declared articles, and in them, where only what nearly all pages repeat does.
LOW, LOW_IN_ARTICLE = 0.3, 0.02
#: In a declared article a text says nothing about repeats on a host of fewer pages.
FEW_PAGES = 8
#: Share of each further style in a node's importance.
GAMMA = 0.9
#: A branch whose text is by more than this in links is a menu.
LINKED = 0.6
#: Elements deeper than this count as part of the one at this depth.
DEEPEST = 64
SALTS = 16

words = lambda s: frozenset(s.split())
VOID = words("area base br col embed hr img input link meta param source track wbr keygen frame")
RAW = words("script style title textarea xmp iframe noembed noframes")
INLINE = words("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img")
HEAD = words("title meta link base script style noscript template")
CLOSES_P = words("address article aside blockquote body center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table ul")
HEADINGS = words("h1 h2 h3 h4 h5 h6")
#: What an opening tag closes, and the elements beyond which it closes nothing.
SIBLINGS = {
    "li": (words("li"), words("ul ol menu table td th")),
    "dt": (words("dt dd"), words("dl table td th")),
    "dd": (words("dt dd"), words("dl table td th")),
    "option": (words("option"), words("select datalist")),
    "optgroup": (words("option optgroup"), words("select")),
    "td": (words("td th"), words("table")),
    "th": (words("td th"), words("table")),
    "tr": (words("tr td th caption"), words("table")),
    "tbody": (words("thead tbody tfoot tr td th caption"), words("table")),
    "thead": (words("thead tbody tfoot tr td th caption"), words("table")),
    "tfoot": (words("thead tbody tfoot tr td th caption"), words("table")),
}
SCOPES = words("table td th caption html object template")
NEVER = words("head script style noscript template nav footer aside menu dialog svg iframe object embed audio video canvas select button textarea input datalist noframes noembed xmp title applet map search fieldset progress meter")
NOISE_ROLES = words("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar tablist tooltip status")
#: Words of class and id names that declare a part not to be the article.
NOISE_WORDS = words(
    "ad ads adv advert adverts advertisement advertisements advertising adsense adsbygoogle adbox adslot adunit sponsor sponsors sponsored promo promos promotion promoted "
    "nav navbar navigation navi topnav subnav menu menus breadcrumb breadcrumbs crumbs sidebar sidebars sidenav aside footer footers masthead topbar toolbar "
    "cookie cookies consent gdpr notice notices notification notifications alert alerts popup modal overlay lightbox banner banners "
    "newsletter subscribe subscription signup signin login register share shares sharing sharebar social follow "
    "comment comments commentlist disqus respond reply replies discussion feedback related recommended recommendations trending "
    "widget widgets pagination pager search searchform form forms copyright skiplink skip paywall hidden outbrain taboola"
)
ARTICLE_NAME = re.compile(r"^(article|post|entry|story|news|blog)[-_]?(body|content|contents|text|main|inner)$|^(articlebody|postbody|entrycontent|storybody|mw-content-text)$", re.I)
MAIN_NAME = re.compile(r"^(main|content|article|post|entry|story|main[-_]?content|main[-_]?text|page[-_]?content|body[-_]?content|content[-_]?(main|body|area))$", re.I)
KEPT_HEADER = re.compile(r"^(article|post|entry|story|news|blog|content|page)[-_]?(header|head|title|heading)$", re.I)
NO_ARTICLE = re.compile(r"^(comment|ad|advert|promo|teaser|related|sponsored|reply)s?$|^comment-(body|content|text)$", re.I)

TAG = re.compile(r"<(?:!--(?:>|->|.*?(?:--!?>|\Z))|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)>|[!?/][^>]*+>?)", re.S)
CUT_TAG = re.compile(r"<(?:/?[a-zA-Z]|!|\?)[^<>]*\Z")
ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'=<>`]+)))?")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
NAME_WORDS = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]*")
DIGITS = re.compile(r"\d+")
HOST = re.compile(r"^\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)")


def key(*values: str | int) -> int:
    """64 bits of the values."""
    return int.from_bytes(blake2b("\x1f".join(map(str, values)).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def host_of(url: str | None) -> str:
    """Host of a URL in lower case without a leading www; empty if there is none."""
    found = HOST.match(url or "")
    host = found.group(1).lower() if found else ""
    return host[4:] if host.startswith("www.") else host


class Element:
    """An element of a page; ``role`` is noise (-1), none (0), or how surely it is the article (1 to 3)."""

    __slots__ = ("name", "sign", "parent", "role", "children", "depth")

    def __init__(self, name: str, sign: str, parent: int, role: int, depth: int) -> None:
        self.name, self.sign, self.parent, self.role, self.depth = name, sign, parent, role, depth
        self.children: list[int] = []


def declared(name: str, attributes: dict[str, str]) -> int:
    """The role that an element's tag, role and names declare."""
    role = attributes.get("role", "").strip().lower()
    names = frozenset((attributes.get("class", "") + " " + attributes.get("id", "")).split())
    if name in NEVER or role in NOISE_ROLES or "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or HIDDEN.search(attributes.get("style", "")):
        return -1
    if name in ("body", "html"):
        return 0
    if name in ("article", "main"):  # other names on them tell of states, such as comments-open
        return -1 if any(NO_ARTICLE.match(n) for n in names) else 3 if name == "article" else 2
    kept = any(KEPT_HEADER.match(n) for n in names)
    if not kept and any(w in NOISE_WORDS for n in names for w in (x.lower() for x in NAME_WORDS.findall(n))):
        return -2  # by name: not if it holds the article itself
    if name == "form":
        return -2
    if name == "header" or not kept and any(w == "header" for n in names for w in (x.lower() for x in NAME_WORDS.findall(n))):
        return -3  # outside of articles only
    if role == "article" or "articlebody" in attributes.get("itemprop", "").lower():
        return 3
    if role == "main" or any(ARTICLE_NAME.match(n) for n in names):
        return 2
    return 1 if any(MAIN_NAME.match(n) for n in names) else 0


class Page:
    """Elements and text blocks of one page. ``blocks`` are (element, text, of it in links), in page order."""

    def __init__(self, source: str) -> None:
        self.elements = [Element("#page", "#page", -1, 0, 0)]
        self.blocks: list[tuple[int, str, int]] = []
        self.parts: list[str] = []
        self.linked = 0
        # open elements as (name, index of the element or of the nearest one above, whether inline, whether shut out)
        self.open: list[tuple[str, int, bool, bool]] = [("#page", 0, False, False)]
        self.count: dict[str, int] = {}
        self.links = 0
        self.read(source)

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.blocks.append((self.open[-1][1], text, min(self.linked, len(text))))
        self.parts, self.linked = [], 0

    def say(self, text: str) -> None:
        if not text or self.open[-1][3]:
            return
        if self.count.get("head") and not text.isspace():
            self.shut("head")
        text = html.unescape(text)
        self.parts.append(text)
        if self.links:
            self.linked += len(text)

    def pop(self) -> None:
        name, _, inline, _ = self.open.pop()
        self.count[name] -= 1
        if name == "a":
            self.links -= 1

    def shut(self, name: str) -> None:
        """Closes the innermost element of that name and all in it."""
        self.flush()
        while self.open[-1][0] != name:
            self.pop()
        self.pop()

    def begin(self, name: str, attributes: dict[str, str]) -> None:
        inline = name in INLINE
        if self.count.get("head") and name not in HEAD and name != "head":
            self.shut("head")
        if name == "html" or name == "body" and self.count.get("body"):
            return
        if not inline:
            self.flush_before(name)
        top = self.open[-1]
        role = declared(name, attributes)
        element, out = top[1], top[3]
        if inline:
            out = out or role < 0 and role > -3
            if name == "a":
                self.links += 1
        elif not out:
            depth = self.elements[top[1]].depth + 1
            if depth <= DEEPEST:
                sign = name + "".join(sorted({"." + DIGITS.sub("0", n) for n in attributes.get("class", "").split()}))
                element = len(self.elements)
                self.elements.append(Element(name, sign, top[1], role, depth))
                self.elements[top[1]].children.append(element)
            out = role == -1
        self.open.append((name, element, inline, out))
        self.count[name] = self.count.get(name, 0) + 1

    def flush_before(self, name: str) -> None:
        self.flush()
        if name in CLOSES_P and self.count.get("p"):
            for i in range(len(self.open) - 1, 0, -1):
                if self.open[i][0] == "p":
                    self.shut("p")
                    break
                if self.open[i][0] in SCOPES or self.open[i][0] == "button":
                    break
        if name in HEADINGS and self.open[-1][0] in HEADINGS:
            self.shut(self.open[-1][0])
        if name in SIBLINGS:
            closes, beyond = SIBLINGS[name]
            last = None
            if any(self.count.get(c) for c in closes):
                for i in range(len(self.open) - 1, 0, -1):
                    if self.open[i][0] in beyond:
                        break
                    if self.open[i][0] in closes:
                        last = i
                        if name in ("li", "dt", "dd", "td", "th", "option"):
                            break
            if last is not None:
                while len(self.open) > last:
                    self.pop()

    def end(self, name: str) -> None:
        if name == "br":
            self.say(" ")
        if name in HEADINGS and not self.count.get(name):
            name = next((h for h in HEADINGS if self.count.get(h)), name)
        if name in ("html", "body") or not self.count.get(name):
            if name == "p":
                self.flush()
            return
        if name in INLINE:
            for i in range(len(self.open) - 1, 0, -1):
                if self.open[i][0] == name:
                    if not self.open[i][2]:
                        return
                    del self.open[i]
                    self.count[name] -= 1
                    self.links -= name == "a"
                    # what stays open inside is shut out only by what is still around it
                    for j in range(i, len(self.open)):
                        n, e, inline, _ = self.open[j]
                        self.open[j] = (n, e, inline, self.open[j - 1][3] or (not inline and self.elements[e].role == -1))
                    return
            return
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i][0] == name:
                self.shut(name)
                return
            if self.open[i][0] in SCOPES and name not in SCOPES and name not in ("tr", "tbody", "thead", "tfoot"):
                return

    def read(self, source: str) -> None:
        at, lower = 0, None
        while True:
            found = TAG.search(source, at)
            if not found:
                break
            self.say(source[at : found.start()])
            at, name = found.end(), found.group(2)
            if not name:
                continue
            name = name.lower()
            if found.group(1):
                self.end(name)
                continue
            attributes: dict[str, str] = {}
            if found.group(3):
                for a in ATTRIBUTE.finditer(found.group(3)):
                    value = a.group(2) or a.group(3) or a.group(4) or ""
                    attributes.setdefault(a.group(1).lower(), html.unescape(value) if "&" in value else value)
            if name in RAW:
                lower = source.lower() if lower is None else lower
                if len(lower) == len(source):
                    ends = lower.find("</" + name, at)
                else:  # lower case of some letters is longer
                    again = re.compile("</" + name, re.I).search(source, at)
                    ends = again.start() if again else -1
                at = len(source) if ends < 0 else ends
                if name not in HEAD:
                    self.flush()
            elif name in VOID:
                if name == "br":
                    self.say(" ")
                elif name not in INLINE:
                    self.flush_before(name)
            else:
                self.begin(name, attributes)
        rest = source[at:]
        cut = CUT_TAG.search(rest)
        self.say(rest[: cut.start()] if cut else rest)
        self.flush()

    def settle(self) -> None:
        """Roles of all elements in their place: below noise all is noise; names and forms are, unless they hold all of
        what the page declares to be its article or, where it declares nothing, most of its text.
        """
        e = self.elements
        articles, text = [0] * len(e), [0] * len(e)
        for i, words_, _ in self.blocks:
            text[i] += len(words_)
        for i in range(len(e) - 1, 0, -1):
            articles[e[i].parent] += articles[i] + (e[i].role >= 2)
            text[e[i].parent] += text[i]
        inside = [False] * len(e)
        for i in range(1, len(e)):
            x, over = e[i], e[e[i].parent]
            inside[i] = inside[x.parent] or x.role > 0
            if over.role == -1:
                x.role = -1
            elif x.role < -1:
                all_of_it = articles[i] == articles[0] if articles[0] else 2 * text[i] > text[0]
                x.role = 0 if all_of_it or x.role == -3 and inside[x.parent] else -1

    def keys(self, host: str) -> list[int]:
        """The node of each element in its host's tree."""
        made: list[int] = []
        for x in self.elements:
            made.append(key(host, x.sign) if x.parent < 0 else key(made[x.parent], x.sign))
        return made

    def nodes(self, host: str) -> tuple[list[int], dict[int, int]]:
        """The node of each element, and the style of each node on this page, menus and the like aside."""
        keys = self.keys(host)
        styles: dict[int, list[str]] = {}
        for k, x in zip(keys, self.elements, strict=True):
            if x.role != -1:
                signs = [self.elements[c].sign for c in x.children]
                run = " ".join(s for s, before in zip(signs, [None, *signs], strict=False) if s != before)
                seen = styles.setdefault(k, [])
                if run not in seen:
                    seen.append(run)
        return keys, {k: key(*s) for k, s in styles.items()}

    def features(self, keys: list[int]) -> list[int]:
        """The text of each block in its node, without case; 0 for those of menus and the like."""
        return [key(keys[i], text.lower()) if self.elements[i].role != -1 else 0 for i, text, _ in self.blocks]

    def main_text(self, stats: dict[int, tuple[float, int, int]], repeats: dict[int, int], host: str) -> str:
        """The blocks that stay, joined by spaces.

        ``stats`` gives presentation importance, number of styles and pages of this page's nodes,
        ``repeats`` the number of pages of those of its texts that more than one page has.
        """
        self.settle()
        e, keys = self.elements, self.keys(host)
        features = self.features(keys)
        live = [b for b, (i, _, _) in enumerate(self.blocks) if e[i].role != -1]
        level = [0] * len(e)
        for i in range(1, len(e)):
            level[i] = max(level[e[i].parent], e[i].role)
        best = max((level[self.blocks[b][0]] for b in live), default=0)
        if best:
            chosen = [b for b in live if level[self.blocks[b][0]] == best or best == 3 and level[self.blocks[b][0]] == 2 and e[self.blocks[b][0]].name == "h1"]
        else:
            chosen = live
        # importance of each block and, by the length of text, of each branch
        weight, mass = [0.0] * len(e), [0.0] * len(e)
        own: dict[int, float] = {}
        linked, text = [0] * len(e), [0] * len(e)
        for b in chosen:
            i, words_, in_links = self.blocks[b]
            presented, styles, pages = stats.get(keys[i], (1.0, 1, 1))
            seen = repeats.get(features[b], 1)
            told = pages >= (FEW_PAGES if best else 2)
            unusual = 1 - min(1.0, log(seen) / log(pages)) if told and seen > 1 else 1.0
            share = GAMMA**styles
            own[b] = (1 - share) * presented + share * unusual
            mass[i] += len(words_) * own[b]
            weight[i] += len(words_)
            linked[i] += in_links
            text[i] += len(words_)
        for i in range(len(e) - 1, 0, -1):
            up = e[i].parent
            linked[up] += linked[i]
            text[up] += text[i]
            if weight[i]:
                presented, styles, _ = stats.get(keys[i], (1.0, 1, 1))
                share = GAMMA**styles
                mass[up] += weight[i] * ((1 - share) * presented + share * mass[i] / weight[i])
                weight[up] += weight[i]
        gone, menus = [False] * len(e), [False] * len(e)
        for i in range(1, len(e)):
            presented, styles, _ = stats.get(keys[i], (1.0, 1, 1))
            share = GAMMA**styles
            low = weight[i] > 0 and (1 - share) * presented + share * mass[i] / weight[i] < (LOW_IN_ARTICLE if best else LOW)
            menu = not best and e[i].name not in ("body", "p") and text[i] > 0 and linked[i] > LINKED * text[i]
            menus[i] = menus[e[i].parent] or menu
            gone[i] = gone[e[i].parent] or menu or low and e[i].name != "body"
        stay = [b for b in chosen if not gone[self.blocks[b][0]] and own[b] >= (LOW_IN_ARTICLE if best else LOW)]
        length = lambda some: sum(len(self.blocks[b][1]) for b in some)
        if not stay or best and 2 * length(stay) <= length(chosen):  # most of an article is no leftover of a template
            stay = [b for b in chosen if not menus[self.blocks[b][0]]] or chosen
        return " ".join(self.blocks[b][1] for b in stay)


def parsed(rows: DataFrame) -> DataFrame:
    """file, row, template, nodes (node, style) and texts of each page of (file, row, url, html)."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            templates, nodes, texts = [], [], []
            for url, source in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                page, host = Page(source or ""), host_of(url)
                page.settle()
                keys, styles = page.nodes(host)
                pairs = [{"node": k, "style": s} for k, s in styles.items()]
                templates.append(key(*(v for p in styles.items() for v in p)))
                nodes.append(pairs)
                texts.append(sorted({f for f in page.features(keys) if f}))
            kinds = [pa.int64(), pa.list_(pa.struct([("node", pa.int64()), ("style", pa.int64())])), pa.list_(pa.int64())]
            made = [pa.array(v, t) for v, t in zip((templates, nodes, texts), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], names=["file", "row", "template", "nodes", "texts"])

    return rows.mapInArrow(parse, "file long, row long, template long, nodes array<struct<node long, style long>>, texts array<long>")


def style_tree(pages: DataFrame) -> DataFrame:
    """node, importance, styles, pages of every node of all hosts' trees, from ``parsed`` pages.

    The importance of a presentation is the entropy of its styles with the number of pages as base, 1 for a single page.
    """
    styles = pages.select(F.explode("nodes").alias("n")).groupBy("n.node", "n.style").agg(F.count("*").alias("k"))
    sums = styles.groupBy("node").agg(F.count("*").alias("styles"), F.sum("k").alias("pages"), F.sum(F.col("k") * F.log("k")).alias("klogk"))
    entropy = (F.log("pages") - F.col("klogk") / F.col("pages")) / F.log("pages")
    return sums.select("node", F.when(F.col("pages") == 1, F.lit(1.0)).otherwise(F.greatest(entropy, F.lit(0.0))).alias("importance"), "styles", "pages")


def repeated_texts(pages: DataFrame) -> DataFrame:
    """text, seen: texts in their nodes that more than one page has, and how many."""
    return pages.select(F.explode("texts").alias("text")).groupBy("text").agg(F.count("*").alias("seen")).where("seen > 1")


def salted(df: DataFrame) -> DataFrame:
    """df once for each salt, to be joined with rows dealt over the salts: a hot key meets in so many tasks."""
    return df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page: the article without menus, notices, adverts, forms, comments and markup.

    Character references are decoded, white space in a block becomes one space, blocks are joined by one. Where a
    page declares its article or main part, its text is taken from there; elsewhere from all of the page, less branches of low
    importance in the host's tree and branches made of links. If nothing were left of what is not declared to be noise, all but the links stays.
    Null and empty pages have an empty text; pages without a host are one host. Rows that repeat a page_id are pages each. An
    empty table gives an empty one; other columns are not carried.
    """
    rows = placed_rows(pages, ["page_id", "url", "html"], "file", "row")
    tree = written(parsed(rows.select("file", "row", "url", "html")), "pages-parsed")
    templates = tree.select("template", "nodes").dropDuplicates(["template"])
    nodes = templates.select("template", F.explode("nodes.node").alias("node"))
    stats = nodes.join(style_tree(tree), "node").groupBy("template").agg(F.collect_list(F.struct("node", "importance", "styles", "pages")).alias("stats"))
    salt = F.pmod(F.xxhash64("file", "row"), F.lit(SALTS)).cast("int").alias("salt")
    of_page = tree.select("file", "row", "template", salt).join(salted(stats), ["template", "salt"]).select("file", "row", "stats")
    texts = tree.select("file", "row", salt, F.explode("texts").alias("text")).join(salted(repeated_texts(tree)), ["text", "salt"])
    repeats = texts.groupBy("file", "row").agg(F.collect_list(F.struct("text", "seen")).alias("repeats"))
    told = of_page.join(repeats, ["file", "row"], "left")
    whole = rows.select("file", "row", "page_id", "url", "html").join(told, ["file", "row"]).select("page_id", "url", "html", "stats", "repeats")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for url, source, stats_, repeats_ in zip(*(batch.column(i).to_pylist() for i in range(1, 5)), strict=True):
                known = {s["node"]: (s["importance"], s["styles"], s["pages"]) for s in stats_}
                again = {r["text"]: r["seen"] for r in repeats_ or []}
                out.append(Page(source or "").main_text(known, again, host_of(url)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], names=["page_id", "url", "text"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return whole.mapInArrow(extract, f"page_id {kind}, url string, text string").select("page_id", "url", "text", n_chars(F.col("text")))


def n_chars(text: Column) -> Column:
    return F.length(text).cast("long").alias("n_chars")
