"""Main text of web pages by two-pass block rules.

Pass one decides each block by its length, its link density and its stop-word
density: good, bad, or (short or middling) open. Pass two gives an open block the
label of its nearest decided neighbours: the common one, else that of the nearer
side; a heading goes with what follows. Regions that a page marks as something
else (menus, headers, footers, sidebars, forms, scripts, comments, by tag, role,
class or id) are bad as a whole; a name that says so in part only, such as
``legal-analysis``, makes its blocks bad unless pass one finds them good. Where a
page has an article or main element its blocks are each other's neighbours, and
what lies outside is bad.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame

from hushlake.llm.common import importable

#: Tags by what they do.
RAW = ("script", "style", "noscript", "template", "textarea", "iframe", "svg", "math", "object", "canvas", "xmp", "noembed", "noframes")
#: Raw elements that may close themselves.
FOREIGN = ("svg", "math")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead title tr ul br".split())
SKIPPED = frozenset("nav header footer aside form button select option menu dialog head title fieldset legend input audio video map".split())
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
ROLES = frozenset("navigation banner contentinfo complementary search menu menubar dialog alert alertdialog form".split())
#: Names of regions beside the main text: plain ones count as parts of longer names too, vague ones there only as a hint.
_PLAIN = "nav|navbar|navigation|menu|menubar|breadcrumbs?|masthead|footer|sidebar|ads?|adverts?|advertisement|advertising|sponsor|sponsored|cookies?|consent|gdpr|popup|modal|newsletter|subscribe|signup|comments?|commentlist|disqus|pagination|pager|copyright"
_VAGUE = "header|banner|foot|side|aside|widget|promo|promotion|notice|overlay|login|share|sharing|social|replies|reply|respond|related|recommended|recommendations|legal|disclaimer|toolbar|skip|search|hidden|breaking|trending|tags|meta"
EXACT = re.compile(rf"(?:^|\s)(?:{_PLAIN}|{_VAGUE})(?:$|\s)")
PART = re.compile(rf"(?:^|[\s_-])(?<!has-)(?<!no-)(?<!with-)(?<!without-)(?:{_PLAIN})(?:$|[\s_-])")
HINT = re.compile(rf"(?:^|[\s_-])(?<!has-)(?<!no-)(?<!with-)(?<!without-)(?:{_PLAIN}|{_VAGUE})(?:$|[\s_-])")
#: Elements that are a text rather than a region: there only a whole name counts; a part is a hint, in an article not even that.
TEXTS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dt dd td th figcaption span a b i em strong small code mark time address".split())
CLEAR, HINTED, MARKED = 0, 1, 2
#: Frequent function words of the four languages of the corpus.
STOP = frozenset(
    "the of and to in a is that it for on with as was are be by this at from or an not his her they you we have has had but which their its were been one all there when who will more no if out so what up about into than them can only other "
    "le la les de des du et en un une que qui dans pour par sur est au aux avec ne pas se ce il elle sont plus ou son sa ses leur mais nous vous "
    "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man "
    "el la los las de que y en un una por con para no se su al lo como más o pero sus le ya es son del ha sin sobre este entre cuando muy también".split()
)
GOOD_LENGTH, SHORT_LENGTH, LINKED, DENSE, SPARSE = 140, 60, 0.5, 0.2, 0.08

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
_ATTR = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_SPACE = re.compile(r"\s+")
_LETTERS = re.compile(r"[^\W\d_]+")
_RAW_END = {t: re.compile(rf"</{t}\b[^>]*(?:>|$)", re.I) for t in RAW}
#: Tags whose open element a new one of the kind ends.
_CLOSES = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_SCOPES = frozenset("ul ol table div article section main body td th nav aside footer header form".split())


def _marked(tag: str, attrs: str, in_article: bool) -> tuple[int, bool]:
    """What a page says of an element, and whether it says so by a tag, a role or its being hidden."""
    if tag in SKIPPED and not (tag == "header" and in_article):
        return MARKED, True
    out = CLEAR
    for name, *values in _ATTR.findall(attrs):
        name, value = name.lower(), next((v for v in values if v), "").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return MARKED, True
        if name == "role" and value in ROLES:
            return MARKED, True
        if name in ("class", "id") and tag not in ("html", "body", "main", "article"):
            if EXACT.search(value) or tag not in TEXTS and PART.search(value):
                out = MARKED
            elif HINT.search(value) and not (tag in TEXTS and in_article):
                out = max(out, HINTED)
    return out, False


class _Open:
    """The open elements, with the places of each tag, so that none is searched for."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, int, bool, bool]] = []  # tag, mark, whether a firm one, whether in an article
        self.places: dict[str, list[int]] = {}
        self.scopes: list[int] = []

    def push(self, tag: str, attrs: str) -> None:
        _, mark, firm, article = self.stack[-1] if self.stack else ("", CLEAR, False, False)
        own, own_firm = _marked(tag, attrs, article)
        if tag in ("article", "main"):  # the name of a wrapper says nothing of the article in it
            mark, article = (mark if firm else CLEAR), True
        self.places.setdefault(tag, []).append(len(self.stack))
        if tag in _SCOPES:
            self.scopes.append(len(self.stack))
        self.stack.append((tag, max(mark, own), firm or own_firm, article))

    def pop(self) -> str:
        tag = self.stack.pop()[0]
        self.places[tag].pop()
        if tag in _SCOPES:
            self.scopes.pop()
        return tag

    def last(self, tag: str) -> int:
        return self.places[tag][-1] if self.places.get(tag) else -1

    def scope(self) -> int:
        return self.scopes[-1] if self.scopes else -1


def blocks(page: str) -> list[dict]:
    """Text blocks in page order: text, characters within links, whether a heading, the page's mark, whether in an article or main element.

    Linear in the page: each element is entered and left once.
    """
    out: list[dict] = []
    opened = _Open()
    parts: list[str] = []
    linked, in_link, in_heading = 0, 0, 0
    at, n = 0, len(page)

    def flush() -> None:
        nonlocal linked
        text = _SPACE.sub(" ", unescape("".join(parts))).strip()
        if text:
            _, mark, _, article = opened.stack[-1] if opened.stack else ("", CLEAR, False, False)
            out.append({"text": text, "linked": linked, "heading": in_heading > 0, "mark": mark, "article": article})
        parts.clear()
        linked = 0

    def words(chunk: str) -> None:
        nonlocal linked
        if chunk:
            parts.append(chunk)
            if in_link:
                linked += len(_SPACE.sub(" ", unescape(chunk)))

    def close(upto: int) -> None:
        nonlocal in_link, in_heading
        while len(opened.stack) > upto:
            if opened.stack[-1][0] in BLOCK:
                flush()
            tag = opened.pop()
            in_link -= tag == "a"
            in_heading -= tag in HEADINGS

    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            words(page[at:])
            break
        words(page[at : m.start()])
        at = m.end()
        tag, ending, attrs = (m[2] or m[5] or "").lower(), bool(m[1] or m[4]), m[3] or m[6] or ""
        if not tag:
            continue
        if ending:
            k = opened.last(tag)
            if k >= 0 and (tag in _SCOPES or opened.scope() < k):
                close(k)
            continue
        if tag in _RAW_END:
            if tag not in FOREIGN or not attrs.rstrip().endswith("/"):
                end = _RAW_END[tag].search(page, at)
                at = end.end() if end else n
            parts.append(" ")
            continue
        if tag in BLOCK:
            flush()
            ends = _CLOSES.get(tag, ("p",)) if tag != "br" else ()
            k = max((opened.last(t) for t in ends), default=-1)
            if k > opened.scope() or k >= 0 and k == opened.scope():
                close(k)
        if tag in VOID:
            continue
        opened.push(tag, attrs)
        in_link += tag == "a"
        in_heading += tag in HEADINGS
    close(0)
    flush()
    return out


def first_pass(b: dict) -> str:
    """good, bad or open."""
    if b["mark"] == MARKED:
        return "bad"
    text = b["text"]
    # A text that is mostly links is a menu; one of an article may be a sentence with long links.
    if b["linked"] / len(text) > LINKED and not (b["article"] and len(text) >= SHORT_LENGTH and _dense(text) >= SPARSE):
        return "open" if b["article"] and b["mark"] == CLEAR else "bad"
    if not b["heading"] and len(text) >= SHORT_LENGTH:
        density = _dense(text)
        if density >= DENSE or len(text) >= GOOD_LENGTH and density >= SPARSE:
            return "good"
    return "bad" if b["mark"] == HINTED else "open"


def _dense(text: str) -> float:
    """Share of stop words among the words."""
    words = _LETTERS.findall(text.lower())
    return sum(w in STOP for w in words) / max(1, len(words))


def second_pass(found: list[dict], labels: list[str]) -> list[bool]:
    """Labels with the open ones replaced by those of their nearest decided neighbours; where all of them are open, nothing speaks against any."""
    if "good" not in labels:
        return [x == "open" for x in labels]
    n = len(labels)
    before, after = [-1] * n, [n] * n
    for k in range(1, n):
        before[k] = k - 1 if labels[k - 1] != "open" else before[k - 1]
    for k in range(n - 2, -1, -1):
        after[k] = k + 1 if labels[k + 1] != "open" else after[k + 1]
    edge = "good" if found[0]["article"] else "bad"  # what lies beyond an article's ends says nothing against it
    out = []
    for k, x in enumerate(labels):
        if x == "open":
            b, a = labels[before[k]] if before[k] >= 0 else edge, labels[after[k]] if after[k] < n else edge
            x = a if a == b or found[k]["heading"] else b if k - before[k] <= after[k] - k else a
        out.append(x == "good")
    return out


def classify(found: list[dict]) -> list[bool]:
    """Whether each block is main text. The blocks of article or main elements, if the page has any that isn't marked, are by themselves."""
    labels = [first_pass(b) for b in found]
    inside = [k for k, b in enumerate(found) if b["article"]]
    if not any(labels[k] != "bad" for k in inside):
        return second_pass(found, labels) if found else []
    out = [False] * len(found)
    # Marked blocks stay bad, but an article's text around them isn't judged by them.
    own = [k for k in inside if found[k]["mark"] != MARKED]
    for k, keep in zip(own, second_pass([found[k] for k in own], [labels[k] for k in own]), strict=True):
        out[k] = keep
    return out


def main_text(page: str | None) -> str:
    """Main text of a page, its blocks joined by one space; empty for null, empty or all-boilerplate pages."""
    found = blocks(page or "")
    return " ".join(b["text"] for b, keep in zip(found, classify(found), strict=True) if keep)


def extract_pages(df: DataFrame) -> DataFrame:
    """``(page_id, url, text, n_chars)``, a row for each row of pages.

    Ids and urls are passed on, nulls too; a null or empty page has an empty text;
    repeated rows have equal ones; pages are read whole in linear time; extra
    columns aren't read; an empty table gives an empty one.
    """
    importable(df.sparkSession)
    kind = {c: df.schema[c].dataType.simpleString() for c in ("page_id", "url")}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [main_text(h) for h in batch["html"]]
            yield pd.DataFrame({"page_id": batch["page_id"], "url": batch["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    return df.select("page_id", "url", "html").mapInPandas(run, f"page_id {kind['page_id']}, url {kind['url']}, text string, n_chars long")
