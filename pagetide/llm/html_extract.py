"""Main-text extraction from HTML by a maximum-scoring contiguous region.

The page becomes one sequence of words and tags. Words score by the zone they
stand in, tags score negative, and one linear scan finds the contiguous region
with the highest sum; what is cut inside an article scores nothing. Menus, adverts and other furniture inside the region is
cut by its element or by its class, id or role.
"""

from __future__ import annotations

import html as html_lib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Score of a token by kind. Words outside the article count against the region
#: only where the page marks its article. `fit_weights` learns the same table.
WEIGHTS = {
    "word:article": 1.0, "word:body": 1.0, "word:rest": -1.0, "word:link": 0.2, "word:cut": -0.25,
    "tag:block": -0.25, "tag:inline": -0.05, "tag:cut": -0.25,
}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|iframe|textarea|title)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)|<[!?][^>]*>|([^<]+)|(<)",
    re.S | re.I,
)
_COMMENT = re.compile(r"<!--.*?(?:-->|\Z)", re.S)
_IN_TAG = re.compile("[>\"']")
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NO_DISPLAY = re.compile(r"(?:^|;)\s*display\s*:\s*none\b", re.I)
_INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CUT_TAGS = frozenset("nav footer aside form button select option dialog menu object applet head".split())
_CUT_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adslot banner breadcrumb breadcrumbs comment comments "
    "consent cookie cookies cookiebar copyright disqus footer gdpr login masthead menu modal nav navbar navigation navigation-menu "
    "newsletter notice notices pager pagination popup promo promotion related reply replies respond search share sharing sidebar "
    "signup site-header siteheader social sponsor sponsored subscribe subscription tags toolbar topbar widget contentinfo complementary".split()
)
_IMPLIED_END = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
_ENDS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_ARTICLE = re.compile(r"<(?:article|main)\b", re.I)
_FORM = re.compile(r"<form\b", re.I)
#: Elements that hold the page or its text, whatever their names say.
_KEPT_TAGS = frozenset("html body article main".split())
#: What follows these in a name is what the page has or lacks, not what the element is.
_STATES = frozenset("no not has with without".split())
#: "social" begins names of furniture only before these; social-sciences is a section.
_SOCIAL = frozenset("bar block box buttons button follow icons icon links link list media menu nav networks share sharing widget".split())


def _begins_furniture(first: str, second: str) -> bool:
    """Whether a name of several parts is furniture by its first one; ad-free says what the page lacks."""
    return first in _CUT_NAMES and second != "free" and (first != "social" or second in _SOCIAL)


def _is_cut(tag: str, attributes: str, in_article: bool) -> bool:
    if tag in _KEPT_TAGS:
        return False
    if tag in _CUT_TAGS or (tag == "header" and not in_article):
        return True
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "hidden":
            if not value.lower().startswith("until"):
                return True
        elif key == "aria-hidden":
            if value.strip().lower() == "true":
                return True
        elif key == "style":
            if _NO_DISPLAY.search(value):
                return True
        elif key in ("class", "id", "role"):
            for name in value.lower().split():
                if name in _CUT_NAMES or (name == "header" and not in_article):
                    return True
                parts = re.split(r"[-_]+", name)
                if len(parts) > 1 and (_begins_furniture(parts[0], parts[1]) or (parts[-1] in _CUT_NAMES and _STATES.isdisjoint(parts))):
                    return True
    return False


class _Tags:
    """Where tags of a page end, in time linear in the page.

    A tag ends at the first `>` outside quotes; without one, its `<` is text.
    What a failed search has passed outside quotes fails for later tags too,
    and the next quote or `>` is looked up once for all places before it.
    """

    def __init__(self, page: str):
        self.page, self.failed = page, set()
        self.begin = self.next = -1

    def _special(self, at: int) -> int:
        if not self.begin <= at <= self.next:
            m = _IN_TAG.search(self.page, at)
            self.begin, self.next = at, m.start() if m else len(self.page)
        return self.next

    def end(self, at: int) -> int:
        """Place of the `>` for the attributes that begin at `at`, or -1."""
        passed = []
        while True:
            quote = self._special(at)
            if self.page[quote : quote + 1] == ">":
                return quote
            if quote in self.failed:
                break
            passed.append(quote)
            if quote == len(self.page) or (close := self.page.find(self.page[quote], quote + 1)) < 0:
                break
            at = close + 1
        self.failed.update(passed)
        return -1


def _pieces(page: str) -> Iterator[tuple[int, str, str, str, str]]:
    """(place, text, slash, tag, attributes) of each text and tag; comments, scripts and the like give nothing."""
    tags, at, last = _Tags(page), 0, page.rfind(">")
    while at < len(page):
        if at > last and page[at] == "<":  # nothing but a comment can begin here
            m = _COMMENT.match(page, at)
            if not m:
                yield at, "<", "", "", ""
            at = m.end() if m else at + 1
            continue
        m = _TOKEN.match(page, at)
        if m[3]:
            end = tags.end(m.end())
            if end < 0:
                yield at, "<", "", "", ""
                at += 1
            else:
                yield at, "", m[2], m[3], page[m.end() : end]
                at = end + 1
            continue
        if text := m[4] or m[5]:
            yield at, text, "", "", ""
        at = m.end()


def tokens(page: str) -> Iterator[tuple[str, str]]:
    """(kind, text) of each word run and tag of a page, in order.

    Kinds are the keys of WEIGHTS, "space", and "furniture" for what is cut
    inside an article. A text token carries its text; a block tag carries one
    space and an inline tag nothing. A form that holds an article, or more than
    half of the words that nothing else cuts, is the page and not furniture.
    """
    wide: set[int] = set()
    if _FORM.search(page):
        held: dict[int, tuple[int, int]] = {}
        opened: list[tuple[int, int, int]] = []  # the open forms, with the words and articles before them
        words = articles = 0
        for kind, text, forms, opens in _walk(page, None):
            while opened and (len(opened) > len(forms) or opened[-1][0] != forms[len(opened) - 1]):
                at, n, a = opened.pop()
                held[at] = (words - n, articles - a)
            opened += [(at, words, articles) for at in forms[len(opened) :]]
            words += len(text.split()) if kind[:5] == "word:" and kind != "word:cut" else 0
            articles += opens
        held |= {at: (words - n, articles - a) for at, n, a in opened}
        wide = {at for at, (n, a) in held.items() if a or 2 * n > words}
    for kind, text, _, _ in _walk(page, wide):
        yield kind, text


def _walk(page: str, wide: set[int] | None) -> Iterator[tuple[str, str, list[int], bool]]:
    """The tokens, with the places of the open forms and whether an article opens.

    Forms that begin at the places `wide` are not cut; None stands for all forms.
    """
    forms: list[int] = []
    marked = _ARTICLE.search(page) is not None
    stack: list[tuple[str, int, int, int]] = []
    blocks: list[int] = []  # places in the stack of what is not inline
    depth: Counter[str] = Counter()
    cut = article = link = 0

    def close(at: int) -> None:
        nonlocal cut, article, link
        for t, c, a, k in stack[at:]:
            cut, article, link = cut - c, article - a, link - k
            depth[t] -= 1
        while blocks and blocks[-1] >= at:
            blocks.pop()
        del forms[len(forms) - sum(t == "form" for t, *_ in stack[at:]) :]
        del stack[at:]

    for place, text, slash, tag, attributes in _pieces(page):
        if text:
            if not text.isspace():
                zone = "cut" if cut else "link" if link and not article else "article" if article else "rest" if marked else "body"
                yield "furniture" if cut and article else f"word:{zone}", text, forms, False
            else:
                yield "space", " ", forms, False
            continue
        tag = tag.lower()
        kind = "furniture" if cut and article else "tag:cut" if cut else "tag:inline" if tag in _INLINE else "tag:block"
        opens = tag in ("article", "main") and not slash and not cut
        yield kind, "" if tag in _INLINE else " ", forms, opens
        if slash:
            if depth[tag]:
                close(next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag))
        elif tag not in _VOID:
            ends = _IMPLIED_END.get(tag, ()) or ({"p"} if tag in _ENDS_P else ())
            if blocks and stack[blocks[-1]][0] in ends:
                close(blocks[-1])
            if not attributes.rstrip().endswith("/"):
                kept = tag == "form" and (wide is None or place in wide)
                # an article inside furniture is furniture
                flags = (int(not kept and _is_cut(tag, attributes, article > 0)), int(opens), int(tag == "a"))
                if tag not in _INLINE:
                    blocks.append(len(stack))
                depth[tag] += 1
                stack.append((tag, *flags))
                if tag == "form":
                    forms.append(place)
                cut, article, link = cut + flags[0], article + flags[1], link + flags[2]


def extract(page: str | None, weights: dict[str, float] = WEIGHTS) -> str:
    """The text of the best region of a page; empty for null or text-free pages."""
    if not page:
        return ""
    kinds, texts = [], []
    best = total = 0.0
    start = first = last = 0
    for i, (kind, text) in enumerate(tokens(page)):
        kinds.append(kind)
        texts.append(text)
        if kind in ("space", "furniture"):
            continue
        total += weights[kind] * (len(text.split()) if kind[0] == "w" else 1)
        if total <= 0:
            total, start = 0.0, i + 1
        elif total > best:
            best, first, last = total, start, i + 1
    out = []
    for kind, text in zip(kinds[first:last], texts[first:last]):
        if kind in ("word:cut", "tag:cut", "furniture"):
            out.append(" ")
        else:
            out.append(html_lib.unescape(text) if "&" in text else text)
    return " ".join("".join(out).split())


def fit_weights(labelled: list[tuple[str, str]], smoothing: float = 1.0) -> dict[str, float]:
    """Weights from labelled pages, as log odds of a token kind inside the main text.

    `labelled` holds (html, main text) of some tens of pages; it is a bounded
    sample that a person has marked. A word token is inside if its text occurs
    in the main text, a tag if both neighbours are.
    """
    inside, outside = dict.fromkeys(WEIGHTS, smoothing), dict.fromkeys(WEIGHTS, smoothing)
    for page, main in labelled:
        sequence = [(k, " ".join(html_lib.unescape(t).split())) for k, t in tokens(page) if k not in ("space", "furniture")]
        marks = [bool(t) and t in main if k[0] == "w" else None for k, t in sequence]
        for i, (kind, text) in enumerate(sequence):
            mark = marks[i]
            if mark is None:
                before = next((x for x in reversed(marks[:i]) if x is not None), False)
                after = next((x for x in marks[i + 1 :] if x is not None), False)
                mark = before and after
            (inside if mark else outside)[kind] += len(text.split()) if kind[0] == "w" else 1
    fitted = {k: math.log(inside[k] / outside[k]) for k in WEIGHTS}
    # what is cut never reaches the text, so it may part two regions only weakly
    floor = {k: -0.25 for k in WEIGHTS if k.endswith(":cut") or k.startswith("tag")}
    return {k: min(max(v, floor[k]), -0.05) if k in floor else v for k, v in fitted.items()}


def extract_text(pages: DataFrame, html: str = "html", weights: dict[str, float] | None = None) -> DataFrame:
    """Main text of every page: the columns of `pages` without the html, and `text`.

    The time is linear in the page, whatever its tags leave open. Null or empty
    html, and pages without any word, give an empty text. Each
    page is treated on its own, so repeated rows give repeated results. An
    input column that is itself called `text` is replaced.
    """
    table = dict(WEIGHTS if weights is None else weights)

    def texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda page: extract(page, table)).astype("object")

    return pages.withColumn("text", F.pandas_udf(texts, "string")(F.col(html))).drop(*([html] if html != "text" else []))
