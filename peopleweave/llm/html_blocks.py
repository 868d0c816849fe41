"""Main text of HTML pages from flat text blocks.

A page is cut into blocks at block-level tags. A block is described by its word count and link density, those of the blocks
before and after it, and by what surrounds it: an element or a class name that stands for page furniture, or
an element that names the article. A form or a furniture name around the article itself is a mere wrapper and does not
count (``_wrappers``). A decision tree trained on the labelled table of ``html_training`` tells main text
from the rest; main blocks are joined in page order.
"""
from __future__ import annotations

import re
from functools import lru_cache
from html import unescape

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import with_results
from .html_training import PAGES

DEPTH, LEAST = 8, 1      # of the tree: levels, and blocks in a leaf

# Names in HTML.
RAW = {"script", "style", "title", "textarea", "noscript", "iframe", "template", "svg", "math", "noframes", "xmp", "object", "audio", "video", "canvas"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark", "q", "s", "samp", "small", "span", "strike",
          "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img", "br", "ruby", "rt", "rp", "label", "picture", "source", "input", "nobr", "center"}
FURNITURE = {"nav", "footer", "aside", "form", "menu", "dialog", "button", "select", "option", "fieldset", "label", "datalist", "optgroup", "head", "legend", "output"}
ARTICLE = {"article", "main"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar"}
# Words in class names and ids that stand for page furniture.
NAMES = {"ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adsense", "adslot", "adbox", "banner", "breadcrumb", "breadcrumbs", "byline", "comment", "comments", "commentlist", "consent", "cookie",
         "cookies", "copyright", "disclaimer", "disqus", "footer", "form", "gdpr", "header", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notification",
         "overlay", "pager", "pagination", "popup", "promo", "promoted", "promotion", "recommended", "related", "replies", "reply", "respond", "search", "share", "sharing", "sidebar", "signup", "skip", "social",
         "sponsor", "sponsored", "subscribe", "subscription", "tags", "toolbar", "topbar", "widget", "widgets", "alert", "aside", "toc", "topnav", "subnav", "sidenav", "cta", "responses", "discussion", "reader"}
# Words that make a furniture name after them a state of a wrapper (has-sidebar), or one before them (nav-open).
STATES, ENDS = {"has", "with", "without", "no"}, {"open", "opened", "closed"}
CONTENT_NAMES = {"article", "content", "entry", "post", "story", "main", "body", "text"}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>[^>\"']+|\"[^\"]*\"|'[^']*'|[\"'])*+)>|<[!?/][^>]*>", re.S)
_ATTR = re.compile(r"""\b(class|id|role|hidden|style|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_WORD_CUT = re.compile(r"[^a-zA-Z]+|(?<=[a-z])(?=[A-Z])")


def _furniture_name(words: list[str]) -> bool:
    """Does a single class name or id, as words, stand for page furniture?"""
    if words[-1] in ENDS and len(words) > 1:
        return False
    named = set()
    for w in words:
        if w in STATES:
            break
        named.add(w)
    named &= NAMES
    return bool(named) and not (named == {"header"} and CONTENT_NAMES & set(words))


@lru_cache(4096)
def _marked(attributes: str) -> tuple[str, bool, bool]:
    """(mark of page furniture: "hard", "soft" for a mere name or none, names content, is the main element) of a tag's attributes."""
    hard = soft = good = main = False
    for name, *values in _ATTR.findall(attributes):
        name, value = name.lower(), next((v for v in values if v), "")
        if name in ("class", "id"):
            for one in value.split():
                words = [w.lower() for w in _WORD_CUT.split(one) if w]
                soft |= bool(words) and _furniture_name(words)
                good |= bool(CONTENT_NAMES.intersection(words))
        elif name == "role":
            soft |= value.lower() == "form"
            hard |= value.lower() in ROLES and value.lower() != "form"
            good |= value.lower() in ARTICLE
            main |= value.lower() == "main"
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and "display:none" in value.replace(" ", "").lower():
            hard = True
    return "hard" if hard else "soft" if soft else "", good and not (hard or soft), main


def _wrappers(cells: list[tuple[int, str]], words: list[int], titles: list[int]) -> set[int]:
    """Marks that lie around the main text of the page and so do not tell it from the rest.

    ``cells`` are the marks and the main and article elements in page order, each with the one around it; ``words`` the words in each, ``titles``
    the places of <h1>. The main element counts first, then the article with the fewest marks around it, then a title. The marks around
    an article must hold a title or be forms, or the article half of the page (comments are articles, too); those around
    a title must hold half of the page (a header may hold one).
    """
    marks, hard, forms, titled, total = [0], [False], [True], [False] * len(cells), words[:]
    for around, kind in cells[1:]:
        marks.append(marks[around] + (kind in ("hard", "soft", "form")))
        hard.append(hard[around] or kind == "hard")
        forms.append(forms[around] and kind != "soft")
    for c in titles:
        titled[c] = True
    for c in range(len(cells) - 1, 0, -1):
        total[cells[c][0]] += total[c]
        titled[cells[c][0]] |= titled[c]
    half = 0.5 * (total[0] - sum(total[c] for c in range(1, len(cells)) if cells[c][1] == "hard" and not hard[cells[c][0]]))

    def chain(c: int) -> set[int]:
        found = set()
        while c:
            if cells[c][1] in ("soft", "form"):
                found.add(c)
            c = cells[c][0]
        return found

    open_cells = [c for c in range(1, len(cells)) if not hard[c]]
    for kind in ("main", "article"):
        here = [c for c in open_cells if cells[c][1] == kind]
        if here:
            best = min(here, key=lambda c: (marks[c], not titled[c], c))
            around = chain(best)
            if kind == "main" or forms[best] or titled[best] or total[best] >= half or around and titled[max(around)]:
                return around
            return set()
    here = [c for c in titles if not hard[c]]
    around = chain(min(here, key=lambda c: (marks[c], c))) if here else set()
    if around and total[max(around)] >= half:
        return around
    # Without a title: forms around most of the page.
    return {c for c in open_cells if cells[c][1] == "form" and forms[c] and total[c] >= half and not here}


def blocks(html: str) -> list[tuple]:
    """(text, words, words in links, furniture, article, content name, heading) of each non-empty block, in page order."""
    out: list[tuple] = []
    stack: list[tuple] = []                     # (element, innermost cell, article, content name) with the flags of all around it
    cells: list[tuple[int, str]] = [(0, "")]    # (cell around it, kind) of the marks and the main and article elements
    titles: list[int] = []                      # cells of <h1>
    pieces: list[str] = []
    linked: list[str] = []
    in_link = heading = False

    def flush():
        nonlocal pieces, linked
        if pieces:
            words = "".join(pieces).split()
            if words:
                cell, art, good = stack[-1][1:] if stack else (0, False, False)
                out.append((" ".join(words), len(words), min(len(words), len("".join(linked).split())), cell, art, good, heading))
            pieces, linked = [], []

    at, size = 0, len(html)
    while at < size:
        m = _TOKEN.search(html, at)
        stop = m.start() if m else size
        if stop > at:
            text = html[at:stop]
            if "&" in text:
                text = unescape(text)
            pieces.append(text)
            if in_link:
                linked.append(text)
        if not m:
            break
        at = m.end()
        name = m[2]
        if not name:
            continue
        name, closing = name.lower(), m[1]
        if name in RAW and not closing:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(html, at) if not m[3].endswith("/") or name not in ("svg", "math") else None
            if end or name in ("script", "style", "textarea", "title"):
                cut = html.find(">", end.start()) if end else -1
                at = cut + 1 if cut >= 0 else size
            continue
        if name == "a":
            in_link = not closing
            linked.append(" ")
            continue
        if name == "br":
            pieces.append(" ")
            linked.append(" ")
            continue
        if name not in INLINE:
            flush()
            in_link = in_link and name not in ("p", "li", "div")
            if name in HEADINGS:
                heading = not closing
        if name in VOID:
            continue
        if closing:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    if name in INLINE and any(e[0] not in INLINE for e in stack[i + 1:]):
                        break
                    if name in INLINE and stack[i][1] != (stack[i - 1][1] if i else 0):
                        flush()
                    del stack[i:]
                    break
            continue
        if name in ("p", "li", "option", "tr", "td", "th", "dt", "dd"):          # a new one ends the open one
            top = stack[-1][0] if stack else ""
            if top == name or (name in ("td", "th") and top in ("td", "th")) or (name in ("dt", "dd") and top in ("dt", "dd")):
                stack.pop()
        elif stack and stack[-1][0] == "p" and name not in INLINE:
            stack.pop()
        cell, art, good = stack[-1][1:] if stack else (0, False, False)
        mark, mark_good, main = _marked(m[3]) if m[3] and not m[3].isspace() else ("", False, False)
        inner = art or name in ARTICLE
        if name in INLINE and not mark and name != "label":
            continue
        mark = "" if name in ("body", "html") else mark
        if name == "form":
            mark = mark if mark == "hard" else "form"
        elif name in FURNITURE:
            mark = "hard"
        elif name == "header" and not art:
            mark = mark or "soft"
        if name in INLINE and mark:
            flush()
        for kind in (mark, "main" if main or name == "main" else "article" if name == "article" else ""):
            if kind:
                cells.append((cell, kind))
                cell = len(cells) - 1
        if name == "h1":
            titles.append(cell)
        if not m[3].endswith("/") or name not in INLINE:
            stack.append((name, cell, inner, good or mark_good))
    flush()
    words = [0] * len(cells)
    for b in out:
        words[b[3]] += b[1]
    wrappers, bad = _wrappers(cells, words, titles), [False]
    for c, (around, kind) in enumerate(cells[1:], 1):
        bad.append(bad[around] or kind in ("hard", "soft", "form") and c not in wrappers)
    return [(*b[:3], bad[b[3]], *b[4:]) for b in out]


FEATURES = ("words", "link_density", "words_before", "link_density_before", "words_after", "link_density_after", "furniture", "outside_article", "in_article", "content_name", "heading")


def features(found: list[tuple]) -> np.ndarray:
    """A row of ``FEATURES`` per block; beyond the ends of the page there are blocks of no words."""
    words = np.array([0, *(b[1] for b in found), 0], float)
    density = np.array([0, *(b[2] / b[1] for b in found), 0], float)
    bad, art, good, head = (np.array([b[i] for b in found], float) for i in (3, 4, 5, 6))
    has = float(art.any())
    return np.column_stack([words[1:-1], density[1:-1], words[:-2], density[:-2], words[2:], density[2:], bad, has * (1 - art), art, good, head])


class Tree:
    """Binary decision tree by Gini impurity; ties go to the earlier feature and the lower threshold."""

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int = DEPTH, least: int = LEAST):
        self.value, self.feature = float(y.mean()) if len(y) else 0.0, None
        best = (2 * self.value * (1 - self.value) * len(y) - 1e-9, None, None)
        if depth and 0 < self.value < 1:
            for f in range(x.shape[1]):
                cuts = np.unique(x[:, f])
                for cut in (cuts[1:] + cuts[:-1]) / 2:
                    left = x[:, f] <= cut
                    n = int(left.sum())
                    if least <= n <= len(y) - least:
                        a, b = y[left].mean(), y[~left].mean()
                        impurity = 2 * a * (1 - a) * n + 2 * b * (1 - b) * (len(y) - n)
                        if impurity < best[0] - 1e-9:
                            best = impurity, f, float(cut)
        if best[1] is not None:
            _, self.feature, self.cut = best
            left = x[:, self.feature] <= self.cut
            self.low, self.high = Tree(x[left], y[left], depth - 1, least), Tree(x[~left], y[~left], depth - 1, least)

    def predict(self, x: np.ndarray) -> np.ndarray:
        if self.feature is None:
            return np.full(len(x), self.value)
        left = x[:, self.feature] <= self.cut
        out = np.empty(len(x))
        out[left], out[~left] = self.low.predict(x[left]), self.high.predict(x[~left])
        return out

    def rules(self, indent: str = "") -> str:
        if self.feature is None:
            return f"{indent}main text: {self.value:.2f}\n"
        return f"{indent}{FEATURES[self.feature]} <= {self.cut:g}\n{self.low.rules(indent + '  ')}{indent}else\n{self.high.rules(indent + '  ')}"


def training_rows(pages=PAGES) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the blocks of the labelled pages."""
    xs, ys = [], []
    for page in pages:
        html = "".join(f"{before}{'w ' * (words - links)}{'<a>' + 'l ' * links + '</a>' if links else ''}{after}" for _, before, words, links, after in page)
        found = blocks(html)
        if len(found) != len(page):
            raise ValueError(f"{len(found)} blocks, {len(page)} labels: {html}")
        xs.append(features(found))
        ys += [label for label, *_ in page]
    return np.concatenate(xs), np.array(ys, float)


@lru_cache(None)
def trained() -> Tree:
    return Tree(*training_rows())


def main_text(html: str, tree: Tree | None = None) -> str:
    found = blocks(html)
    if not found:
        return ""
    chosen = (tree or trained()).predict(features(found)) >= 0.5
    return " ".join(b[0] for b, main in zip(found, chosen) if main)


def extract(pages: DataFrame, *, html_col: str = "html", keep: list[str] | None = None) -> DataFrame:
    """``pages`` with text (the main text, empty if none) and n_chars (its code points).

    Null html is empty. Every page is treated by itself, so repeated rows repeat; kept columns named like a result are replaced.
    """
    def start():
        tree = trained()

        def work(columns):
            texts = [main_text(h, tree) for h in columns["html"]]
            return [texts, list(map(len, texts))]

        return work

    return with_results(pages, {"html": F.coalesce(F.col(f"`{html_col}`"), F.lit(""))}, start, {"text": "string", "n_chars": "long"}, keep)
