"""Leaf blocks of an HTML page: their text, the tags and names around them, and how much of it is links."""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(/?)([A-Za-z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|))*+)>"  # a quote opens a value after = only
    r"|<(/?)([A-Za-z][^\s/>]*+)([^>]*+)(?:>|\Z)",
    re.S,
)
NAMES = re.compile(r"(?<![\w-])(?:class|id|role)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++))", re.I)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

#: Elements whose content is no text of the page; it goes up to their end tag, whatever is in it.
RAW = frozenset("script style title textarea noscript template svg math iframe object canvas audio video select button xmp noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that start and end a block.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot"
    " th thead tr ul".split()
)
#: What a start tag closes if it is open at the top.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"},
    "tr": {"td", "th", "tr"}, "tbody": {"td", "th", "tr", "thead", "tbody"}, "tfoot": {"td", "th", "tr", "tbody"},
}


@dataclass(frozen=True)
class Leaf:
    """A block of text; ``around``: its element's tag, tags above it (^tag) and name parts of both (.part)."""

    text: str
    tag: str
    around: frozenset[str]
    linked: float


def name_parts(attributes: str) -> set[str]:
    found = set()
    for m in NAMES.finditer(attributes):
        found.update("." + p.lower() for p in PART.findall(m[1] or m[2] or m[3] or ""))
    return found


def leaves(page: str | None) -> list[Leaf]:
    """Blocks of a page in page order.  Markup errors are taken as browsers take the common ones.

    Character references are decoded, white space becomes one space; blocks without text are left out.
    """
    page = page or ""
    out: list[Leaf] = []
    stack: list[tuple[str, frozenset[str]]] = [("", frozenset())]
    opened: Counter[str] = Counter()
    parts: list[str] = []
    in_link, link_chars, at = 0, 0, 0

    def say(text: str) -> None:
        nonlocal link_chars
        if text:
            parts.append(html.unescape(text))
            if in_link:
                link_chars += len(parts[-1])

    def flush() -> None:
        nonlocal link_chars
        if parts:
            raw = "".join(parts)
            text = " ".join(raw.split())
            if text:
                tag, around = stack[-1]
                out.append(Leaf(text, tag, around, min(1.0, link_chars / len(raw))))
            parts.clear()
            link_chars = 0

    def close(tag: str) -> None:
        while True:
            top, _ = stack.pop()
            opened[top] -= 1
            if top == tag:
                return

    while m := TOKEN.search(page, at):
        say(page[at : m.start()])
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            continue
        tag, end = tag.lower(), bool(m[1] or m[4])
        if tag in RAW:
            if not end and not (m[3] or m[6] or "").endswith("/"):
                stop = re.compile(rf"</{tag}(?![\w-])[^>]*+(?:>|\Z)", re.I).search(page, at)
                if stop or tag in ("script", "style", "textarea", "title"):
                    at = stop.end() if stop else len(page)
        elif tag == "br":
            parts.append(" ")
        elif tag == "a":
            in_link = 0 if end else 1
        elif tag in BLOCK:
            flush()
            if tag in VOID:
                continue
            in_link = 0
            if end:
                if opened[tag]:
                    close(tag)
                continue
            if stack[-1][0] == "p":
                close("p")
            while stack[-1][0] in CLOSES.get(tag, ()):
                close(stack[-1][0])
            own = {f"^{tag}"} | name_parts(m[3] or m[6] or "")
            above = stack[-1][1]
            stack.append((tag, above if own <= above else above | own))
            opened[tag] += 1
    say(page[at:])
    flush()
    return out
