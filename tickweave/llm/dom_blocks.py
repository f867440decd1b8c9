"""Leaf blocks of a web page: text between block boundaries, with what stands above it.

A tolerant reader of tags, not a browser: end tags close the nearest open element of
their name, a new paragraph or list item closes the one before it, a head ends at the first
tag or text that may not stand in one, and raw elements run to their end tag. Text of
scripts, styles and other elements that show nothing is left out. A page cut off anywhere
gives the blocks up to there.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from html import unescape

#: Fixed values of the HTML standard, as far as they matter here.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre "
    "search section select summary table tbody td textarea tfoot th thead tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN_TAGS = frozenset("script style title head template noscript iframe object svg math canvas audio video textarea".split())
#: Any other start tag ends an open head, as its end tag may be left out.
IN_HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
#: A start tag closes open elements of these names, up to the nearest of those behind.
CLOSES = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dd": (("dd", "dt"), ("dl",)),
    "dt": (("dd", "dt"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select",)),
}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>[^>\"']+|\"[^\"]*\"|'[^']*'|[\"'])*)(?:>|\Z)|<[!?][^>]*(?:>|\Z)|[^<]+|<",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([^\s/>="'][^\s/>=]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?""")
_DISPLAY = re.compile(r"(?:^|;)\s*display\s*:\s*([a-z-]+)\s*(!\s*important)?", re.I)
#: Attributes whose values name what an element is for.
NAMING = frozenset("class id role aria-label itemprop".split())


@dataclass(frozen=True)
class Element:
    tag: str
    names: str
    hidden: bool
    mark: str = ""


@dataclass
class Block:
    """The text of a leaf block, its open elements from the outside in, and link characters."""

    text: str
    path: tuple[Element, ...]
    linked: int
    mark: str = ""


def _is_hidden(values: dict[str, str]) -> bool:
    """By the attribute ``hidden``, ``aria-hidden=true``, or the display that the style ends with."""
    if "hidden" in values or values.get("aria-hidden", "").strip().lower() == "true":
        return True
    found = _DISPLAY.findall(unescape(values.get("style", "")))
    decisive = [d for d in found if d[1]] or found
    return bool(decisive) and decisive[-1][0].lower() == "none"


def _element(tag: str, attributes: str) -> Element:
    values: dict[str, str] = {}
    for name, value in _ATTRIBUTE.findall(attributes):
        values.setdefault(name.lower(), value.strip("\"'"))  # the first of a name counts
    names = " ".join(v for n, v in values.items() if n in NAMING and v)
    return Element(tag, names, tag in HIDDEN_TAGS or _is_hidden(values), values.get("data-y", ""))


def leaf_blocks(html: str | None) -> list[Block]:
    """Blocks with text, in page order, white space inside turned into single spaces."""
    html = html or ""
    blocks: list[Block] = []
    path: list[Element] = []
    pieces: list[str] = []
    linked = 0
    at: tuple[Element, ...] = ()

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                mark = next((e.mark for e in reversed(at) if e.mark), "")
                blocks.append(Block(text, at, min(linked, len(text)), mark))
            pieces.clear()
            linked = 0

    def close(names: tuple[str, ...], stops: tuple[str, ...]) -> None:
        for k in range(len(path) - 1, -1, -1):
            if path[k].tag in stops:
                return
            if path[k].tag in names:
                del path[k:]
                return

    pos, size = 0, len(html)
    while pos < size:
        found = _TOKEN.match(html, pos)
        pos = found.end()
        end, tag, attributes = found.groups()
        if tag is None:
            raw = found.group()
            if raw.startswith(("<!", "<?")):
                continue
            if path and path[-1].tag == "head" and raw.strip():
                path.pop()
            if not any(e.hidden for e in path):
                if not pieces:
                    at = tuple(path)
                text = unescape(raw)
                pieces.append(text)
                if any(e.tag == "a" for e in path):
                    linked += len(text.strip())
            continue
        tag = tag.lower()
        if end:
            if tag in BLOCK_TAGS:
                flush()
            close((tag,), ())
            continue
        if tag == "body":
            close(("head",), ("template",))
        elif path and path[-1].tag == "head" and tag not in IN_HEAD:
            path.pop()
        if tag == "br":
            pieces.append(" ") if pieces else None
            continue
        if tag in BLOCK_TAGS:
            flush()
            close(("p",), ("body", "td", "th", "li", "dd", "article", "section", "div", "button"))
            if tag in CLOSES:
                close(*CLOSES[tag])
        if tag in VOID_TAGS:
            continue
        element = _element(tag, attributes)
        if tag in RAW_TAGS:
            stop = re.compile(f"</{tag}(?![\\w-])", re.I).search(html, pos)
            pos = stop.start() if stop else size
            if not stop:
                break
        if not attributes.rstrip().endswith("/") or tag in BLOCK_TAGS:
            path.append(element)
    flush()
    return blocks
