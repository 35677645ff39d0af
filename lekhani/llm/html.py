"""Main text of web pages: flat text blocks, classified by a decision tree over their own and their neighbours' features.

A page is cut at block-level tags into text blocks. Each has a number of words, a link density (share of words inside
links), the same two of the blocks before and after it, and what its surrounding elements say: whether one is boilerplate
by its tag, role, class or id; whether it stands in an article; whether the page has one elsewhere; and whether it is a
heading. A tree grown here on a small labelled table decides.

Null or empty pages and pages without main text give "". Character references are decoded, white space inside a block
is one space, blocks are joined by one line feed. Unclosed and stray tags are tolerated; very long pages are read whole, in
linear time. Equal pages get equal texts; blocks are never dropped for being repeated. A form is boilerplate, but an article
inside a form that wraps the page isn't, and a page whose text is all inside forms is judged as if it had none. An empty table
gives an empty one. Columns other than id, address and page are left out, whatever their names.
"""

from __future__ import annotations

import html as references
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lekhani.llm.common import small_batches, table

#: Fixed: elements of HTML by kind.
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
UNREAD = set("script style noscript template iframe object svg math canvas audio video head title textarea select option datalist noembed noframes".split())
RAW = set("script style textarea title iframe noembed noframes noscript".split())
BOILERPLATE = set("nav footer aside form menu button dialog fieldset".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
ROLES = set("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar".split())
#: Words of a class or id that name boilerplate, alone or as the start of a word; the last ones are neutral inside an article.
NAMED = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?\w*|advertis\w*|adsense|sponsor\w*|promo\w*|banner\w*|cookie\w*|consent|gdpr|notice\w*|alert\w*|notification\w*|popup\w*|modal\w*|overlay|newsletter\w*|subscri\w*|sign-?up|log-?in|"
    r"side-?bar\w*|menu\w*|nav|navbar\w*|navigation|breadcrumb\w*|pagination|pager|toolbar\w*|footer\w*|comment\w*|respond|repl(?:y|ies)|disqus\w*|share\w*|sharing|social\w*|related\w*|recommend\w*|widget\w*|skip\w*|copyright|disclaimer)(?=$|[\s_-])",
    re.IGNORECASE,
)
NAMED_OUTSIDE = re.compile(r"(?:^|[\s_-])(?:(?:site|page|top|main)-?header|masthead|header|topbar|search\w*|tags?|meta)(?=$|[\s_-])", re.IGNORECASE)
NAMED_ARTICLE = re.compile(r"(?:^|[\s_-])(?:article(?:-?(?:body|content|text))?|(?:entry|post|story|page|main)-?(?:content|body|text)|content)(?=$|[\s_-])", re.IGNORECASE)

#: Elements that hold a stretch of an article's own text: for them a class or id counts only if all its parts are such words.
TEXTUAL = set("p h1 h2 h3 h4 h5 h6 blockquote pre li dt dd td th figcaption".split())
_TAG = re.compile(r"<(?:(/?)([A-Za-z][^\s/>]*)|!--|[!?])")
#: Where a tag may end, or the value in quotation marks of an attribute begins.
_STOP = re.compile(r">|=\s*([\"'])")
_ATTRIBUTE = re.compile(r"(?<![^\s=/>\"'])([^\s=/>\"']+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))|(?<=\s)(hidden)(?=[\s/]|$)")
#: Ends of elements whose content is read as it stands.
_RAW_END = {name: re.compile(rf"</{name}", re.IGNORECASE | re.ASCII) for name in RAW}

#: A labelled table of blocks: boilerplate around it, inside an article, the page's article is elsewhere, heading; words and
#: link density of the block, of the one before and of the one after; and 1 for main text.
TABLE = """
0 1 0 1 1 0.0 0 0.0 2 1.0 1
1 0 1 1 1 0.0 0 0.0 2 1.0 0
0 0 1 1 1 0.0 0 0.0 2 1.0 0
1 1 0 1 1 0.0 0 0.0 2 1.0 0
0 1 0 0 1 0.0 5 0.0 60 0.0 1
1 0 1 0 1 0.0 5 0.0 60 0.0 0
0 0 1 0 1 0.0 5 0.0 60 0.0 0
1 1 0 0 1 0.0 5 0.0 60 0.0 0
0 1 0 0 1 0.0 60 0.0 5 0.0 1
1 0 1 0 1 0.0 60 0.0 5 0.0 0
0 0 1 0 1 0.0 60 0.0 5 0.0 0
1 1 0 0 1 0.0 60 0.0 5 0.0 0
0 1 0 0 2 0.0 2 1.0 12 0.5 1
1 0 1 0 2 0.0 2 1.0 12 0.5 0
0 0 1 0 2 0.0 2 1.0 12 0.5 0
1 1 0 0 2 0.0 2 1.0 12 0.5 0
0 1 0 0 2 0.0 12 0.5 2 1.0 1
1 0 1 0 2 0.0 12 0.5 2 1.0 0
0 0 1 0 2 0.0 12 0.5 2 1.0 0
1 1 0 0 2 0.0 12 0.5 2 1.0 0
0 1 0 1 2 0.0 0 0.0 60 0.0 1
0 1 0 0 4 1.0 5 0.0 0 0.0 1
1 0 1 0 4 1.0 5 0.0 0 0.0 0
0 0 1 0 4 1.0 5 0.0 0 0.0 0
1 1 0 0 4 1.0 5 0.0 0 0.0 0
0 1 0 1 4 1.0 60 0.0 12 0.5 1
1 0 1 1 4 1.0 60 0.0 12 0.5 0
0 0 1 1 4 1.0 60 0.0 12 0.5 0
1 1 0 1 4 1.0 60 0.0 12 0.5 0
0 1 0 0 4 1.0 2 1.0 2 1.0 1
1 0 1 0 4 1.0 2 1.0 2 1.0 0
0 0 1 0 4 1.0 2 1.0 2 1.0 0
1 1 0 0 4 1.0 2 1.0 2 1.0 0
0 1 0 1 7 0.3 12 0.5 5 0.0 1
1 0 1 1 7 0.3 12 0.5 5 0.0 0
0 0 1 1 7 0.3 12 0.5 5 0.0 0
1 1 0 1 7 0.3 12 0.5 5 0.0 0
0 1 0 0 7 0.3 0 0.0 0 0.0 1
1 0 1 0 7 0.3 0 0.0 0 0.0 0
0 0 1 0 7 0.3 0 0.0 0 0.0 0
1 1 0 0 7 0.3 0 0.0 0 0.0 0
0 1 0 0 7 0.3 5 0.0 12 0.5 1
0 1 0 0 15 0.0 60 0.0 60 0.0 1
1 0 1 0 15 0.0 60 0.0 60 0.0 0
0 0 1 0 15 0.0 60 0.0 60 0.0 0
1 1 0 0 15 0.0 60 0.0 60 0.0 0
0 1 0 0 15 0.0 2 1.0 5 0.0 1
1 0 1 0 15 0.0 2 1.0 5 0.0 0
0 0 1 0 15 0.0 2 1.0 5 0.0 0
1 1 0 0 15 0.0 2 1.0 5 0.0 0
0 1 0 1 15 0.0 12 0.5 0 0.0 1
1 0 1 1 15 0.0 12 0.5 0 0.0 0
0 0 1 1 15 0.0 12 0.5 0 0.0 0
1 1 0 1 15 0.0 12 0.5 0 0.0 0
0 1 0 0 40 0.1 0 0.0 2 1.0 1
1 0 1 0 40 0.1 0 0.0 2 1.0 0
0 0 1 0 40 0.1 0 0.0 2 1.0 0
1 1 0 0 40 0.1 0 0.0 2 1.0 0
0 1 0 1 40 0.1 5 0.0 60 0.0 1
1 0 1 1 40 0.1 5 0.0 60 0.0 0
0 0 1 1 40 0.1 5 0.0 60 0.0 0
1 1 0 1 40 0.1 5 0.0 60 0.0 0
0 1 0 0 40 0.1 60 0.0 5 0.0 1
0 1 0 1 120 0.0 2 1.0 12 0.5 1
1 0 1 1 120 0.0 2 1.0 12 0.5 0
0 0 1 1 120 0.0 2 1.0 12 0.5 0
1 1 0 1 120 0.0 2 1.0 12 0.5 0
0 1 0 0 120 0.0 12 0.5 2 1.0 1
1 0 1 0 120 0.0 12 0.5 2 1.0 0
0 0 1 0 120 0.0 12 0.5 2 1.0 0
1 1 0 0 120 0.0 12 0.5 2 1.0 0
0 1 0 0 120 0.0 0 0.0 60 0.0 1
1 0 1 0 120 0.0 0 0.0 60 0.0 0
0 0 1 0 120 0.0 0 0.0 60 0.0 0
1 1 0 0 120 0.0 0 0.0 60 0.0 0
0 0 0 0 65 0.0 8 0.0 72 0.0 1
0 0 0 0 72 0.05 65 0.0 30 0.0 1
0 0 0 0 30 0.0 72 0.0 4 1.0 1
0 0 0 0 30 0.0 0 0.0 0 0.0 1
0 0 0 0 18 0.0 65 0.0 40 0.0 1
0 0 0 0 14 0.0 40 0.0 3 0.0 1
0 0 0 0 14 0.2 2 1.0 2 1.0 1
0 0 0 1 8 0.0 3 1.0 65 0.0 1
0 0 0 1 5 0.0 30 0.0 50 0.0 1
0 0 0 0 4 0.0 60 0.0 55 0.0 1
0 0 0 0 3 0.0 20 0.0 24 0.0 1
0 0 0 0 2 0.0 40 0.0 40 0.0 1
0 0 0 0 1 0.0 14 0.0 30 0.0 1
0 0 0 0 4 0.0 35 0.0 0 0.0 1
0 0 0 0 6 0.1 25 0.0 5 0.0 1
0 0 0 0 11 0.0 0 0.0 0 0.0 1
0 0 0 0 45 0.3 30 0.0 20 0.1 1
0 0 0 0 2 1.0 0 0.0 2 1.0 0
0 0 0 0 3 1.0 2 1.0 2 1.0 0
0 0 0 0 10 0.9 3 1.0 4 1.0 0
0 0 0 0 20 0.8 40 0.0 12 0.7 0
0 0 0 0 4 0.0 3 1.0 2 1.0 0
0 0 0 0 2 0.0 1 1.0 1 1.0 0
0 0 0 0 6 0.6 30 0.0 0 0.0 0
0 0 0 0 3 0.0 2 1.0 0 0.0 0
0 0 0 0 5 0.8 45 0.0 40 0.0 0
0 0 0 0 1 1.0 15 0.0 30 0.0 0
0 0 0 0 40 0.9 60 0.0 60 0.0 0
0 0 0 0 3 1.0 60 0.0 0 0.0 0
"""
COLUMNS = ["boilerplate", "in_article", "article_elsewhere", "heading", "words", "links", "words_before", "links_before", "words_after", "links_after"]


class Tree:
    """A binary decision tree grown by Gini impurity; of equally good cuts the first column and smallest value are taken."""

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int = 8):
        self.value = bool(2 * y.sum() >= len(y))
        self.cut: tuple[int, float] | None = None
        if depth == 0 or y.min() == y.max():
            return
        best = (self._gini(y) * len(y) - 1e-9, -1, 0.0)
        for c in range(x.shape[1]):
            values = np.unique(x[:, c])
            for v in (values[1:] + values[:-1]) / 2:
                low = x[:, c] <= v
                cost = self._gini(y[low]) * low.sum() + self._gini(y[~low]) * (~low).sum()
                if cost < best[0] - 1e-9:
                    best = (cost, c, float(v))
        if best[1] >= 0:
            self.cut = best[1:]
            low = x[:, best[1]] <= best[2]
            self.low, self.high = Tree(x[low], y[low], depth - 1), Tree(x[~low], y[~low], depth - 1)

    @staticmethod
    def _gini(y: np.ndarray) -> float:
        p = y.mean()
        return float(2 * p * (1 - p))

    def decide(self, row: tuple) -> bool:
        node = self
        while node.cut:
            node = node.low if row[node.cut[0]] <= node.cut[1] else node.high
        return node.value


def grow(text: str = TABLE) -> Tree:
    rows = np.array([[float(v) for v in line.split()] for line in text.strip().splitlines()])
    return Tree(rows[:, :-1], rows[:, -1])


def _names(rest: str) -> dict[str, str]:
    out = {}
    for m in _ATTRIBUTE.finditer(rest):
        if m[5]:
            out["hidden"] = ""
        else:
            out.setdefault(m[1].lower(), m[2] if m[2] is not None else m[3] if m[3] is not None else m[4])
    return out


class Ends:
    """Finds where tags end, in time linear in the page: `>` inside a quoted value ends none, unless no tag would end at all."""

    def __init__(self, page: str):
        self.page, self.loose, self.unclosed = page, False, set()

    def of(self, at: int) -> int:
        """The place of the `>` that ends the tag whose name ends at `at`; -1 if there is none."""
        begin = at
        while not self.loose:
            m = _STOP.search(self.page, at)
            if not m:
                self.loose = True  # as later tags would find none either
            elif not m[1]:
                return m.start()
            else:
                close = -1 if m[1] in self.unclosed else self.page.find(m[1], m.end())
                if close < 0:
                    self.unclosed.add(m[1])
                at = m.end() if close < 0 else close + 1
        return self.page.find(">", begin)


class Block:
    __slots__ = ("article", "begun", "boilerplate", "heading", "linked", "parts")

    def __init__(self) -> None:
        self.parts: list[str] = []
        self.linked, self.boilerplate, self.article, self.heading, self.begun = 0, 0, False, False, False


#: Kinds of boilerplate: none, only a form's, any other.
PLAIN, FORM, OTHER = 0, 1, 2


def blocks(page: str) -> list[tuple[str, float, int, int, bool, bool]]:
    """(text, link density, words, kind of boilerplate, in article, heading) of each block that has text, in page order."""
    out: list[tuple[str, float, int, int, bool, bool]] = []
    stack: list[tuple[str, int, bool, bool]] = []  # element, and of it and those around it: boilerplate, an article, unread
    open_of: dict[str, int] = {}
    links, heading, block, ends = 0, 0, Block(), Ends(page)
    at = 0

    def state() -> tuple[int, bool, bool]:
        return stack[-1][1:] if stack else (PLAIN, False, False)

    def add(text: str) -> None:
        if not text or state()[2]:
            return
        text = references.unescape(text)
        if text.strip():
            if not block.begun:
                block.boilerplate, block.article = state()[:2]
                block.heading, block.begun = heading > 0, True
            if links:
                block.linked += len(text.split())
        block.parts.append(text)

    def flush() -> None:
        nonlocal block
        text = " ".join("".join(block.parts).split())
        if text:
            words = text.count(" ") + 1
            out.append((text, min(1.0, block.linked / words), words, block.boilerplate, block.article, block.heading))
        if block.parts:
            block = Block()

    while (lt := page.find("<", at)) >= 0:
        m = _TAG.match(page, lt)
        if not m:
            add(page[at : lt + 1])
            at = lt + 1
            continue
        end = ends.of(m.end()) if m[2] else 0
        if end < 0:
            break  # no tag ends after this: the rest is text
        add(page[at:lt])
        at = m.end()
        if not m[2]:
            mark = "-->" if m[0] == "<!--" else ">"
            end = page.find(mark, at)
            at = len(page) if end < 0 else end + len(mark)
            continue
        name, closing, rest, at = m[2].lower(), bool(m[1]), page[at:end], end + 1
        if name == "br":
            add(" ")
        elif name == "a":
            links = 0 if closing else 1
        elif name not in INLINE:
            flush()
        if name in HEADINGS:
            heading = 0 if closing else 1
        if name in VOID or name in INLINE and not (rest and not closing):
            continue
        if closing:
            if open_of.get(name):
                while True:
                    top = stack.pop()[0]
                    open_of[top] -= 1
                    if top == name:
                        break
                    if top == "a":
                        links = 0
            continue
        boiler, article, unread = state()
        attributes = _names(rest) if rest else {}
        label = f"{attributes.get('class', '')} {attributes.get('id', '')}"
        if article and name in TEXTUAL:  # `related-work` or `notice-text` say nothing of an article's paragraph
            label = " ".join(w for w in label.split() if all(map(NAMED.search, re.split("[-_]", w))))
        inside = name in ("article", "main") or attributes.get("role") in ("main", "article") or attributes.get("itemprop") == "articleBody" or bool(label.strip() and NAMED_ARTICLE.search(label))
        form = name in ("form", "fieldset") or attributes.get("role", "").lower() == "form"
        bad = name in BOILERPLATE and not form or attributes.get("role", "").lower() in ROLES or "hidden" in attributes or attributes.get("aria-hidden") == "true" or "display:none" in attributes.get("style", "").replace(" ", "").lower()
        bad = bad or bool(label.strip()) and name not in ("html", "body") and bool(NAMED.search(label) or not article and not inside and NAMED_OUTSIDE.search(label))
        bad = bad or name == "header" and not article
        if name in RAW:
            close = _RAW_END[name].search(page, at)
            gt = page.find(">", close.end()) if close else -1
            at = len(page) if gt < 0 else gt + 1
            continue
        if name in INLINE and not bad or rest.endswith("/") and name not in INLINE:
            continue
        if name == "body":  # ends a head that was left open
            stack.clear()
            open_of.clear()
            boiler, article, unread = PLAIN, False, False
        if name in ("p", "li", "dt", "dd", "option", "tr", "td", "th") and stack and stack[-1][0] == name:
            stack.pop()  # ended by the next of its kind
            open_of[name] -= 1
            boiler, article, unread = state()
        if name in ("article", "main") and boiler == FORM:
            boiler = PLAIN
        stack.append((name, max(boiler, OTHER if bad else FORM if form else PLAIN), article or inside, unread or name in UNREAD))
        open_of[name] = open_of.get(name, 0) + 1
    add(page[at:])
    flush()
    return out


def main_text(page: str | None, tree: Tree) -> str:
    found = blocks(page or "")
    forms = any(b[3] == PLAIN for b in found)  # else a form wraps all that could be the text
    found = [(t, d, w, kind == OTHER or forms and kind == FORM, a, h) for t, d, w, kind, a, h in found]
    has = any(article and not boiler for _, _, _, boiler, article, _ in found)
    edge = ("", 0.0, 0)
    kept = []
    for i, (text, density, words, boiler, article, heading) in enumerate(found):
        before, after = found[i - 1] if i else edge, found[i + 1] if i + 1 < len(found) else edge
        if tree.decide((boiler, article, has and not article, heading, words, density, before[2], before[1], after[2], after[1])):
            kept.append(text)
    return "\n".join(kept)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row: id, url, text, n_chars. Other columns are left out."""
    schema = f"id {pages.schema[id_col].dataType.simpleString()}, url {pages.schema[url_col].dataType.simpleString()}, text string, n_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = grow()
        for batch in small_batches(batches, 2):
            texts = [main_text(h, tree) for h in batch.column(2).to_pylist()]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["id", "url", "text", "n_chars"])

    return pages.select(id_col, url_col, html_col).mapInArrow(run, schema).withColumnsRenamed({"id": id_col, "url": url_col})


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
