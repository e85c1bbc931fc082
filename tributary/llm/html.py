"""Main text of web pages: flat text blocks classified by a decision tree.

A page is read once into flat blocks, one for each stretch of text between
block-level tags. A block is described by its words, its link density, the same
of the blocks before and after it, and by where it stands (inside an article,
under a boilerplate element, heading, list item). A small decision tree, grown
by Gini impurity from the labelled table below, keeps or drops it. Where a page
marks an article that is no boilerplate, only blocks in it can be main text.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of HTML: elements that do not end a block, that have no end tag, whose content is never shown as text.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark math q ruby rt rp s samp small span strike strong sub sup time tt u var wbr br img mi mn mo ms mtext mrow mfrac msup msub msqrt semantics".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe noembed noframes".split())
UNSHOWN = frozenset("template noscript object svg select button canvas audio video annotation".split())
#: Elements, roles and names in class and id that mark what is not the article.
SHELL = frozenset("nav header footer aside form menu dialog fieldset".split())
ROLES = frozenset("banner navigation complementary contentinfo search form dialog alertdialog alert menu menubar toolbar".split())
CUES = frozenset("ad ads adv advert advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar aside widget related recommended comment comments reply replies disqus respond cookie cookies consent notice notices alert popup modal overlay newsletter subscribe signup share sharing social search login copyright complementary contentinfo teaser teasers".split())
#: Words that may stand beside a cue in one name (site-header, comment-list); with any other word a name tells nothing.
PARTS = frozenset("site page main global primary secondary top bottom left right side bar list lists item items box block section area container inner body content contents form link links button buttons group column col panel pane thread slot unit text title row post entry article user reader the of div li ul id module region zone".split())
ARTICLE = frozenset("article main".split())
#: Boilerplate that can hold articles of its own (teasers, comments), as against wrappers of a page that only bear a cue.
HARD_TAGS = frozenset("nav header footer aside menu dialog".split())
HARD = frozenset("ad ads adv advert advertisement advertising sponsor sponsored promo promotion nav navbar navigation menu footer sidebar aside widget related recommended teaser teasers comment comments reply replies disqus respond complementary contentinfo".split())
#: First words of names that tell about something else on the page, and last words that tell about its layout.
MODIFIERS = frozenset("no not has with without hide show is".split())
LAYOUT = frozenset("open closed enabled disabled layout page left right wrap wrapper".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
LISTS = frozenset("li ul ol".split())

_SIMPLE = re.compile(r"</?([a-zA-Z][^\s/<>\"']*+)([^<>\"']*+)>")
_NAME = re.compile(r"</?([a-zA-Z][^\s/<>]*+)")
_STOP = re.compile("[\"'<>]")
_CUE = re.compile(r"""(?<![^\s"'/])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_WORD = re.compile(r"[a-z]+")
_HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")
_SIZE = re.compile(r"[0-9]+(?:x[0-9]+)?")
_TEASER = re.compile(r"(?:div-|li-)?(?:comment|reply|teaser|related|recommended|promo|sponsored|ad|advert)(?:-(?:body|item|content|\d+))*")


def tokens(page: str):
    """Yield (kind, tag, rest) of a page in one pass: kind "text" (the text in tag), "open", "close", or "gap" for a raw element.

    Every character is looked at a bounded number of times, however broken the
    markup. A tag ends at its first unquoted >, before an unquoted <, or at the
    page's end, where it is dropped; a quote opens a value only after =, and one
    that is never closed is an ordinary character. Raw elements and comments run
    to their end or the page's.
    """
    at, n = 0, len(page)
    last = {q: page.rfind(q) for q in ("'", '"')}
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            yield "text", page[at:], ""
            return
        if lt > at:
            yield "text", page[at:lt], ""
        at = lt
        simple = _SIMPLE.match(page, at)
        name = simple or _NAME.match(page, at)
        if not name:
            if page.startswith("<!--", at):
                end = page.find("-->", at + 4)
                at = n if end < 0 else end + 3
            elif page.startswith(("<!", "<?", "</"), at):
                end = page.find(">", at)
                at = n if end < 0 else end + 1
            else:
                yield "text", "<", ""
                at += 1
            continue
        shut, tag = page[at + 1] == "/", name[1].lower()
        if simple:
            rest, at = simple[2], simple.end()
        else:
            begin = k = name.end()
            while True:
                m = _STOP.search(page, k)
                if not m:
                    return  # a tag cut off by the page's end
                c, k = m[0], m.end()
                if c == ">":
                    rest, at = page[begin : k - 1], k
                    break
                if c == "<":
                    rest, at = page[begin : k - 1], k - 1
                    break
                if k <= last[c] and page[max(begin, k - 65) : k - 1].rstrip()[-1:] == "=":
                    k = page.find(c, k) + 1
        if shut:
            yield "close", tag, ""
            continue
        yield "open", tag, rest
        if tag in RAW:
            end = _raw_end(tag).search(page, at)
            if not end:
                return
            at = end.start()


@lru_cache(maxsize=32)
def _raw_end(tag: str):
    return re.compile(rf"</{tag}(?=[\s/>])", re.I)


FEATURES = ("in_article", "shell", "heading", "item", "words", "links", "words_before", "links_before", "words_after", "links_after")
#: Labelled blocks of hand-made pages: the features above, then 1 for main text.
LABELLED = (
    # menus, headers, breadcrumbs
    (0, 1, 0, 1, 1, 1.0, 0, 0.0, 1, 1.0, 0), (0, 1, 0, 1, 2, 1.0, 1, 1.0, 1, 1.0, 0), (0, 1, 0, 1, 1, 1.0, 2, 1.0, 6, 0.0, 0),
    (0, 0, 0, 1, 1, 1.0, 1, 1.0, 2, 1.0, 0), (0, 0, 0, 1, 3, 1.0, 1, 1.0, 40, 0.0, 0), (0, 1, 1, 0, 4, 0.0, 0, 0.0, 1, 1.0, 0),
    (0, 1, 0, 0, 6, 0.5, 4, 0.0, 9, 0.0, 0), (0, 0, 0, 0, 5, 1.0, 2, 1.0, 3, 1.0, 0), (1, 1, 0, 1, 2, 1.0, 1, 1.0, 1, 1.0, 0),
    # adverts, notices, forms, sidebars
    (0, 1, 0, 0, 7, 0.0, 1, 1.0, 10, 0.0, 0), (0, 1, 0, 0, 25, 0.1, 1, 1.0, 8, 0.0, 0), (1, 1, 0, 0, 12, 0.0, 60, 0.0, 45, 0.0, 0),
    (1, 1, 0, 0, 60, 0.0, 50, 0.0, 45, 0.0, 0), (0, 1, 0, 0, 30, 0.0, 0, 0.0, 12, 0.0, 0), (0, 1, 0, 0, 80, 0.0, 9, 0.0, 14, 0.2, 0),
    (0, 1, 1, 0, 3, 0.0, 40, 0.0, 5, 1.0, 0), (0, 1, 0, 1, 8, 1.0, 3, 0.0, 7, 1.0, 0), (0, 0, 0, 0, 4, 0.0, 2, 1.0, 3, 1.0, 0),
    # reader comments and footers
    (0, 1, 0, 0, 35, 0.0, 3, 0.5, 20, 0.0, 0), (1, 1, 0, 0, 18, 0.0, 35, 0.0, 22, 0.0, 0), (0, 1, 0, 0, 12, 0.0, 50, 0.0, 0, 0.0, 0),
    (0, 1, 0, 0, 9, 0.3, 30, 0.0, 0, 0.0, 0), (0, 1, 0, 0, 110, 0.0, 20, 0.0, 4, 0.0, 0), (0, 0, 0, 0, 5, 0.8, 3, 1.0, 0, 0.0, 0),
    (1, 0, 0, 1, 6, 1.0, 4, 1.0, 5, 1.0, 1), (1, 0, 0, 1, 5, 1.0, 40, 0.0, 6, 1.0, 1), (1, 0, 0, 0, 9, 1.0, 8, 1.0, 7, 1.0, 1),
    # titles and paragraphs of articles, long and short
    (1, 0, 1, 0, 8, 0.0, 7, 0.0, 45, 0.0, 1), (1, 0, 1, 0, 1, 0.0, 2, 1.0, 3, 0.0, 1), (1, 0, 1, 0, 12, 0.0, 0, 0.0, 12, 0.0, 1),
    (1, 0, 0, 0, 45, 0.0, 8, 0.0, 60, 0.0, 1), (1, 0, 0, 0, 60, 0.05, 45, 0.0, 2, 0.0, 1), (1, 0, 0, 0, 2, 0.0, 60, 0.0, 30, 0.0, 1),
    (1, 0, 0, 0, 1, 0.0, 1, 0.0, 9, 0.3, 1), (1, 0, 0, 0, 30, 0.2, 2, 0.0, 12, 0.0, 1), (1, 0, 0, 0, 220, 0.0, 30, 0.0, 12, 0.0, 1),
    (1, 0, 0, 0, 9, 0.0, 12, 0.0, 15, 0.3, 1), (1, 0, 0, 0, 14, 0.4, 40, 0.0, 33, 0.0, 1), (1, 0, 0, 0, 3, 0.0, 0, 0.0, 0, 0.0, 1),
    (1, 0, 0, 1, 7, 0.0, 40, 0.0, 9, 0.0, 1), (1, 0, 0, 1, 4, 0.0, 7, 0.0, 30, 0.0, 1), (1, 0, 0, 1, 16, 0.3, 9, 0.0, 12, 0.0, 1),
    (1, 0, 0, 0, 20, 0.0, 30, 0.0, 4, 1.0, 1), (1, 0, 1, 0, 6, 0.0, 0, 0.0, 3, 1.0, 1), (1, 0, 0, 0, 5, 0.1, 9, 0.0, 2, 0.9, 1),
    # inside articles after blocks of links: short and medium paragraphs, list items, paragraphs and items that are mostly or only links
    (1, 0, 0, 0, 4, 0.0, 2, 1.0, 3, 1.0, 1), (1, 0, 0, 0, 12, 0.0, 1, 1.0, 30, 0.0, 1), (1, 0, 0, 0, 25, 0.0, 6, 1.0, 40, 0.0, 1), (1, 0, 0, 0, 47, 0.1, 3, 1.0, 9, 0.0, 1),
    (1, 0, 0, 0, 8, 0.0, 9, 0.7, 5, 0.0, 1), (1, 0, 0, 1, 3, 0.0, 5, 0.8, 4, 0.0, 1), (1, 0, 0, 1, 10, 0.2, 4, 1.0, 6, 1.0, 1), (1, 0, 0, 1, 30, 0.0, 8, 0.9, 0, 0.0, 1),
    (1, 0, 0, 0, 10, 0.7, 30, 0.0, 20, 0.0, 1), (1, 0, 0, 0, 20, 0.9, 9, 0.0, 12, 0.0, 1), (1, 0, 0, 0, 6, 1.0, 40, 0.0, 30, 0.0, 1), (1, 0, 0, 1, 6, 0.8, 5, 0.9, 7, 0.8, 1),
    # pages without an article element
    (0, 0, 1, 0, 7, 0.0, 2, 1.0, 40, 0.0, 1), (0, 0, 0, 0, 40, 0.0, 7, 0.0, 55, 0.0, 1), (0, 0, 0, 0, 55, 0.1, 40, 0.0, 6, 0.0, 1),
    (0, 0, 0, 0, 6, 0.0, 55, 0.1, 48, 0.0, 1), (0, 0, 0, 0, 26, 0.0, 0, 0.0, 0, 0.0, 1), (0, 0, 0, 0, 90, 0.0, 3, 1.0, 9, 1.0, 1),
    (0, 0, 0, 1, 12, 0.0, 40, 0.0, 14, 0.0, 1), (0, 0, 1, 0, 3, 0.0, 48, 0.0, 50, 0.0, 1), (0, 0, 0, 0, 12, 0.0, 40, 0.0, 50, 0.0, 1),
    # the same without an article: long link blocks go, short text among text stays, also right behind a link block; short text between link blocks goes
    (0, 0, 0, 0, 7, 1.0, 40, 0.0, 6, 0.0, 0), (0, 0, 0, 0, 12, 1.0, 9, 0.0, 55, 0.0, 0), (0, 0, 0, 1, 9, 0.9, 30, 0.0, 8, 1.0, 0), (0, 0, 0, 0, 30, 0.8, 20, 0.0, 25, 0.0, 0),
    (0, 0, 0, 0, 60, 1.0, 40, 0.0, 12, 0.0, 0), (0, 0, 0, 0, 2, 0.0, 40, 0.0, 30, 0.0, 1), (0, 0, 0, 0, 1, 0.0, 12, 0.0, 9, 0.0, 1), (0, 0, 0, 1, 3, 0.0, 8, 0.0, 4, 0.0, 1),
    (0, 0, 0, 0, 5, 0.0, 0, 0.0, 8, 0.0, 1), (0, 0, 0, 0, 7, 0.0, 2, 1.0, 3, 1.0, 0), (0, 0, 0, 0, 3, 0.0, 4, 0.9, 1, 1.0, 0),
    (0, 0, 0, 0, 5, 0.0, 40, 0.0, 0, 0.0, 1), (0, 0, 0, 0, 4, 0.0, 0, 0.0, 0, 0.0, 1), (0, 0, 0, 0, 12, 0.0, 20, 0.0, 2, 1.0, 1), (0, 0, 0, 1, 6, 0.0, 5, 0.0, 1, 1.0, 1),
    (0, 0, 0, 0, 15, 0.0, 8, 0.1, 3, 1.0, 1), (0, 0, 0, 0, 6, 0.0, 3, 1.0, 20, 0.0, 1), (0, 0, 0, 0, 10, 0.0, 2, 1.0, 8, 0.0, 1), (0, 0, 0, 0, 2, 0.3, 9, 0.0, 2, 0.0, 1),
    (0, 0, 1, 0, 3, 0.0, 2, 1.0, 40, 0.0, 1), (0, 0, 1, 0, 5, 0.0, 3, 1.0, 8, 0.0, 1), (0, 0, 1, 0, 2, 0.0, 4, 0.9, 3, 0.0, 1), (0, 0, 1, 0, 10, 0.0, 2, 1.0, 12, 0.0, 1),
    # and short text at the end of text stays before links
    (0, 0, 0, 0, 5, 0.0, 30, 0.0, 2, 1.0, 1), (0, 0, 0, 0, 3, 0.0, 12, 0.0, 4, 1.0, 1), (0, 0, 0, 0, 8, 0.1, 50, 0.0, 1, 1.0, 1), (0, 0, 0, 0, 6, 0.0, 4, 0.1, 2, 1.0, 1), (0, 0, 0, 0, 5, 0.0, 2, 1.0, 4, 1.0, 0), (0, 0, 0, 0, 8, 0.0, 1, 1.0, 2, 1.0, 0),
    (0, 0, 0, 0, 30, 0.0, 2, 1.0, 20, 0.0, 1), (0, 0, 0, 0, 20, 0.0, 3, 1.0, 9, 0.0, 1), (0, 0, 0, 0, 40, 0.0, 3, 1.0, 30, 0.0, 1),
)


def grow(rows: np.ndarray, labels: np.ndarray, depth: int = 8):
    """A decision tree: (feature, threshold, low branch, high branch), or a leaf's share of label 1."""
    share = float(labels.mean())
    if depth == 0 or share in (0.0, 1.0):
        return share
    best = None
    for f in range(rows.shape[1]):
        values = np.unique(rows[:, f])
        for t in (values[1:] + values[:-1]) / 2:
            low = rows[:, f] <= t
            score = sum(m.sum() * (p := labels[m].mean()) * (1 - p) for m in (low, ~low))
            if best is None or score < best[0] - 1e-12:
                best = (score, f, float(t), low)
    if best is None:
        return share
    _, f, t, low = best
    return f, t, grow(rows[low], labels[low], depth - 1), grow(rows[~low], labels[~low], depth - 1)


@lru_cache(maxsize=1)
def default_tree():
    table = np.array(LABELLED, float)
    return grow(table[:, :-1], table[:, -1])


def classify(tree, row) -> float:
    while isinstance(tree, tuple):
        f, t, low, high = tree
        tree = low if row[f] <= t else high
    return tree


def _cue(name: str) -> int:
    """What a name in class or id tells, taken whole: 0 nothing, 1 a cue, 2 boilerplate with all articles in it."""
    words = _WORD.findall(_SIZE.sub(" ", _HUMP.sub("-", name).lower()))
    if not words or words[0] in MODIFIERS or words[-1] in LAYOUT and len(words) > 1:
        return 0
    if not all(w in CUES or w in PARTS for w in words) or not any(w in CUES for w in words):
        return 0
    return 2 if any(w in HARD for w in words) else 1


def boilerplate(tag: str, rest: str) -> int:
    """What an element says of what it holds: 0 nothing, 1 boilerplate unless an article in it says otherwise, 2 boilerplate with all articles in it."""
    marks = [(m[1].lower(), m[2] or m[3] or m[4] or "") for m in _CUE.finditer(rest)]
    names = [t for kind, value in marks if kind != "role" for t in value.split()]
    if tag in ARTICLE:
        return 2 if tag == "article" and any(_TEASER.fullmatch(t.lower()) for t in names) else 0
    if tag in ("body", "html"):
        return 0
    level = 2 if tag in HARD_TAGS else int(tag in SHELL)
    if any(kind == "role" and ROLES.intersection(value.lower().split()) for kind, value in marks):
        level = max(level, 1)
    return max([level, *map(_cue, names)])


class _Open:
    """An open element: level of boilerplate, in an article, under a heading, in a list item, place of the nearest list or item."""

    __slots__ = ("tag", "shell", "article", "heading", "item", "near", "own")

    def __init__(self, tag, shell, article, heading, item, near, own):
        self.tag, self.shell, self.article, self.heading, self.item, self.near, self.own = tag, shell, article, heading, item, near, own


_ROOT = _Open("", 0, False, False, False, -1, False)


def blocks(page: str) -> list[tuple[str, tuple]]:
    """(text, features) of each non-empty block in page order."""
    found: list[list] = []
    text: list[str] = []
    linked: list[str] = []
    stack: list[_Open] = []
    many: Counter = Counter()  # open elements by name
    hidden: list[str] = []  # the open element that is not shown, and those in it
    inside: Counter = Counter()
    anchors = 0

    def close() -> None:
        words = " ".join(unescape("".join(text)).split())
        if words:
            n = words.count(" ") + 1
            links = len(unescape("".join(linked)).split())
            top = stack[-1] if stack else _ROOT
            found.append([words, int(top.article), int(top.shell > 0), int(top.heading), int(top.item), n, min(1.0, links / n)])
        text.clear()
        linked.clear()

    def cut(k: int) -> None:
        for x in stack[k:]:
            many[x.tag] -= 1
        del stack[k:]

    for kind, tag, rest in tokens(page):
        if hidden:
            if kind == "open" and tag not in VOID and not rest.endswith("/"):
                hidden.append(tag)
                inside[tag] += 1
            elif kind == "close" and inside[tag]:
                while True:
                    name = hidden.pop()
                    inside[name] -= 1
                    if name == tag:
                        break
            elif kind == "close" and many[tag]:  # what holds the unshown element ends
                hidden.clear()
                inside.clear()
                kind = "end"
            if kind != "end":
                continue
            kind = "close"
        if kind == "text":
            text.append(tag)
            if anchors:
                linked.append(tag)
            continue
        if tag in RAW:
            text.append(" ")
            continue
        if tag in UNSHOWN:
            text.append(" ")
            if kind == "open" and not rest.endswith("/"):
                hidden.append(tag)
                inside[tag] += 1
            continue
        if tag in INLINE:
            if tag == "a":
                anchors = int(kind == "open")
                linked.append(" ")
            elif tag in ("br", "img"):
                text.append(" ")
                linked.append(" ")
            continue
        close()
        anchors = 0
        if tag in VOID:
            continue
        if kind == "close":
            if many[tag]:
                k = len(stack) - 1
                while stack[k].tag != tag:
                    k -= 1
                cut(k)
            continue
        if stack and stack[-1].tag == "p":
            cut(len(stack) - 1)
        if tag == "li" and stack and stack[-1].near >= 0 and stack[stack[-1].near].tag == "li":
            cut(stack[-1].near)
        up = stack[-1] if stack else _ROOT
        shell, article, own = up.shell, up.article, up.own
        level = boilerplate(tag, rest)
        if tag in ARTICLE and not article and not level and (shell < 2 or tag == "main"):
            shell, article = 0, True  # an article under a wrapper that only bears a cue
        if tag == "header":  # the article's own header: its headings are the article's
            own = article and not shell and boilerplate("div", rest) < 2
        elif level:
            own = False
        shell = max(shell, level)
        heading = up.heading or tag in HEADING
        if own and tag in HEADING and not level:
            shell = 0
        stack.append(_Open(tag, shell, article, heading, up.item or tag == "li", len(stack) if tag in LISTS else up.near, own))
        many[tag] += 1
    close()
    out = []
    for k, (words, article, shell, heading, item, n, links) in enumerate(found):
        before = found[k - 1][5:7] if k else (0, 0.0)
        after = found[k + 1][5:7] if k + 1 < len(found) else (0, 0.0)
        out.append((words, (article, shell, heading, item, n, links, *before, *after)))
    return out


def main_text(page: str | None, tree=None) -> str:
    """Blocks that the tree keeps, joined by two line ends. None and pages without text give ''."""
    tree = tree or default_tree()
    found = blocks(page or "")
    if any(f[0] and not f[1] for _, f in found):  # where the page marks an article that is no boilerplate, only what it holds can be main text
        found = [(t, f) for t, f in found if f[0]]
    return "\n\n".join(t for t, f in found if classify(tree, f) > 0.5)


def extract_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",), labelled=None) -> DataFrame:
    """One row per input row: id_col, the columns of keep, text, n_chars (code points).

    Null html is empty and gives empty text; a cut page is read to its end.
    labelled: another table like LABELLED to train on. Other columns are not read.
    """
    tree = None
    if labelled is not None:
        table = np.array(labelled, float)
        tree = grow(table[:, :-1], table[:, -1])
    source = pages.select(id_col, *keep, F.col(html_col).alias("_html"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]) + ", text string, n_chars long"

    def run(batches):
        for batch in batches:
            texts = [main_text(x, tree) for x in batch.column(batch.num_columns - 1).to_pylist()]
            columns = [*batch.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-1], "text", "n_chars"])

    return source.mapInArrow(run, schema)


def op6_html(spark, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
