"""A lenient reading of HTML: text runs with the path of elements around them."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

_TOKEN = re.compile(
    r"<!--(?:.*?-->|.*\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<lend>/?)(?P<lname>[a-zA-Z][^\s/>]*)(?P<lrest>[^>]*)>|<[!?/][^>]*>?",
    re.S,
)
_ATTRIBUTE = re.compile(r"([a-zA-Z][\w:-]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_SPACE = re.compile(r"\s+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp template".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data dfn em font i ins kbd label mark q s samp small span strike strong sub "
    "sup time tt u var wbr del".split()
)
#: A start tag of these ends an open element of the same kind within the given parents.
SIBLINGS = {
    "li": ("ul", "ol", "menu"),
    "dt": ("dl",),
    "dd": ("dl",),
    "tr": ("table",),
    "td": ("tr", "table"),
    "th": ("tr", "table"),
    "option": ("select", "datalist"),
}
#: What is not the article: elements, roles, and words of class and id.
ASIDE_TAGS = frozenset(
    "nav header footer aside form dialog menu button select option fieldset head svg math object canvas audio video "
    "figure-ad template".split()
) | RAW
ASIDE_ROLES = frozenset(
    "navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar status".split()
)
ASIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent "
    "gdpr notice notices popup modal overlay newsletter subscribe subscription signup login paywall sidebar menu nav "
    "navbar navigation breadcrumb breadcrumbs pagination pager footer header masthead topbar share sharing social "
    "toolbar widget legal copyright disclaimer skip".split()
)
#: Beginnings of words that are written together, as in "sidebarbox".
ASIDE_STEMS = ("advert", "sidebar", "cookie", "newsletter", "navbar", "breadcrumb", "footer", "sponsor", "promo", "banner", "popup")
REPLY_WORDS = frozenset("comment comments commentlist disqus reply replies respond responses discussion related recommended".split())
#: Where the article is, best first.
REGION_WORDS = (
    frozenset(["articlebody"]),
    frozenset(["maincontent"]),
    frozenset("content article post entry story".split()),
)


@dataclass(slots=True)
class Element:
    name: str
    label: str
    path: str
    aside: bool  # it or an ancestor is not the article
    reply: bool
    region: int  # 0: none; smaller numbers are better


@dataclass(slots=True)
class Run:
    """Text without markup between, the path of its element, and whether the article can hold it."""

    text: str
    element: Element
    block: int  # runs of one block touch


def _attributes(rest: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(rest)}


def _element(name: str, rest: str, parent: Element | None, in_region: bool) -> Element:
    found = _attributes(rest) if rest.strip(" /") else {}
    classes = sorted(re.sub(r"\d+", "0", found.get("class", "").lower()).split())
    own_id = re.sub(r"\d+", "0", found.get("id", "").lower())
    words = {w.lower() for w in _WORD.findall(f"{found.get('class', '')} {found.get('id', '')}")}
    role = found.get("role", "").lower()
    label = ".".join([name, *classes]) + (f"#{own_id}" if own_id else "") + (f"@{role}" if role else "")
    region = 0
    if name == "article" or found.get("itemprop", "").lower() == "articlebody":
        region = 1
    elif name == "main" or role == "main":
        region = 2
    elif name not in ("body", "html"):
        region = next((3 + i for i, some in enumerate(REGION_WORDS) if {*words, *classes, own_id} & some), 0)
    hidden = "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
    reply = bool(words & REPLY_WORDS)
    off = name in ASIDE_TAGS or role in ASIDE_ROLES or hidden or reply
    named = bool(words & ASIDE_WORDS) or any(w.startswith(ASIDE_STEMS) for w in words)
    off = off or (named and name not in ("body", "html", "article", "main"))
    if off:
        region = 0
    above = parent is not None and parent.aside
    if above and region in (1, 2) and not parent.reply and not in_region:
        above = False  # an element before the article was left open
    label = label.replace("/", "|")  # a path is cut at slashes
    path = f"{parent.path}/{label}" if parent else label
    return Element(name, label, path, off or above, reply or (parent is not None and parent.reply), region)


_ROOT = Element("", "", "", False, False, 0)


def runs(source: str) -> Iterator[Run | Element]:
    """Elements as they open, and text runs, in page order."""
    stack = [_ROOT]
    at = block = 0
    size = len(source)

    def text(piece: str) -> Run:
        return Run(html.unescape(piece), stack[-1], block)

    while at < size:
        tag = _TOKEN.search(source, at)
        if tag is None:
            yield text(source[at:])
            return
        if tag.start() > at:
            yield text(source[at : tag.start()])
        at = tag.end()
        name = (tag["name"] or tag["lname"] or "").lower()
        if not name:
            continue
        if name not in INLINE:
            block += 1
        if tag["end"] or tag["lend"]:
            _close(stack, name)
            continue
        if name in VOID:
            continue
        _make_room(stack, name)
        rest = tag["rest"] or tag["lrest"] or ""
        element = _element(name, rest, stack[-1], any(e.region in (1, 2) for e in stack))
        yield element
        if name in RAW:
            closing = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(source, at)
            at = closing.end() if closing else size
            block += 1
        elif not rest.rstrip().endswith("/") or name not in ("svg", "math", "path"):
            stack.append(element)


def _close(stack: list[Element], name: str) -> None:
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].name == name:
            del stack[i:]
            return
        if name in INLINE and stack[i].name not in INLINE:
            return  # an inline end tag does not close blocks


def _make_room(stack: list[Element], name: str) -> None:
    if name in SIBLINGS:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].name == name or (name in ("dt", "dd") and stack[i].name in ("dt", "dd")) or (name in ("td", "th") and stack[i].name in ("td", "th")):
                del stack[i:]
                return
            if stack[i].name in SIBLINGS[name]:
                return
    elif name not in INLINE:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].name == "p":  # blocks end an open paragraph
                del stack[i:]
                return
            if stack[i].name not in INLINE:
                return


def spaced(text: str) -> str:
    return _SPACE.sub(" ", text).strip()
