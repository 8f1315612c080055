"""HTML as leaf blocks: runs of text that no block element parts, each with the elements that it stands in."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text up to their end tag is no markup, and is no text of the page.
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
#: Elements whose text is no text of the page.
HIDDEN = frozenset("template select datalist svg math object audio video canvas button".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: An element that begins ends an open one of these, unless one of the others stands between.
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}), "td": ({"td", "th"}, {"table"}), "th": ({"td", "th"}, {"table"}),
    "tr": ({"tr"}, {"table"}), "tbody": ({"tbody", "thead", "tfoot"}, {"table"}), "thead": ({"tbody", "thead", "tfoot"}, {"table"}), "tfoot": ({"tbody", "thead", "tfoot"}, {"table"}), "a": ({"a"}, set()),
}
_SCOPE = frozenset("html table td th caption template object".split())
#: Open elements at most; what is deeper becomes their sibling.
DEPTH = 512

_W = r"\t\n\f\r "
_TAG = re.compile(rf"""<(/?)([A-Za-z][^{_W}/>]*+)((?:[{_W}/]++|=|[^{_W}/>=]++(?:[{_W}]*+=[{_W}]*+(?:"[^"]*+"|'[^']*+'|[^{_W}>]*+))?+)*+)>""")
_COMMENT = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))", re.S)
_BOGUS = re.compile(r"<(?:[!?]|/[^A-Za-z])[^>]*+(?:>|\Z)")
_OPEN_TAG = re.compile(r"</?[A-Za-z]")


@dataclass(slots=True)
class Element:
    tag: str
    attributes: str
    number: int


@dataclass(slots=True)
class Leaf:
    text: str
    linked: int  # characters of it in links
    path: tuple[Element, ...]


def _pieces(html: str) -> Iterator[tuple[str, str, str]]:
    """("", text, "") of what is between tags, ("+", name, attributes) of start tags, ("-", name, "") of end tags. Comments, declarations and raw text are left out; a tag that the page's end cuts off is too."""
    at, n = 0, len(html)
    while at < n:
        stop = html.find("<", at)
        if stop < 0:
            yield "", html[at:], ""
            return
        if stop > at:
            yield "", html[at:stop], ""
        if html.startswith("<!--", stop):
            at = _COMMENT.match(html, stop).end()
        elif m := _TAG.match(html, stop):
            at, name = m.end(), m[2].lower()
            yield "-" if m[1] else "+", name, m[3]
            if not m[1] and name in RAW:
                end = re.compile(rf"</{name}(?=[{_W}/>])", re.I).search(html, at)
                if end is None:
                    return
                at = end.start()
        elif m := _BOGUS.match(html, stop):
            at = m.end()
        elif _OPEN_TAG.match(html, stop):
            return
        else:
            yield "", "<", ""
            at = stop + 1


def leaves(html: str) -> list[Leaf]:
    """The leaf blocks of a page that have text, in order. White space in a block is one space; character references are decoded; br is white space.

    Start and end tags are matched as browsers do in the main: paragraphs end where a block begins, items, cells and rows where the next begins, end tags
    without a start are ignored, and an element's end ends what is open in it.
    """
    out: list[Leaf] = []
    stack: list[Element] = []
    held: list[str] = []
    linked = hidden = number = 0
    path: tuple[Element, ...] = ()
    open_: defaultdict[str, int] = defaultdict(int)

    def flush() -> None:
        nonlocal linked
        if held:
            text = " ".join("".join(held).split())
            if text:
                out.append(Leaf(text, min(linked, len(text)), path))
            held.clear()
            linked = 0

    def close(k: int) -> None:
        nonlocal hidden
        for e in stack[k:]:
            hidden -= e.tag in HIDDEN
            open_[e.tag] -= 1
            if e.tag in BLOCK:
                flush()
        del stack[k:]

    def end(of, but) -> None:
        for t in of:
            if open_[t]:
                break
        else:
            return
        for k in range(len(stack) - 1, -1, -1):
            if stack[k].tag in of:
                close(k)
                return
            if stack[k].tag in but:
                return

    for kind, name, attributes in _pieces(html):
        if not kind:
            if not hidden:
                text = unescape(name)
                if not held:
                    if text.isspace():
                        continue
                    path = tuple(stack)
                held.append(text)
                if open_["a"]:
                    linked += len(text.strip())
            continue
        if kind == "-":
            if name == "br":
                if held:
                    held.append(" ")
            elif name in BLOCK:
                flush()
                end({name}, _SCOPE - {name})
            else:
                end({name}, BLOCK)
            continue
        if name in BLOCK:
            flush()
            end({"p"}, _SCOPE)
            if name in HEADINGS and stack and stack[-1].tag in HEADINGS:
                close(len(stack) - 1)
        if name in _ENDS:
            end(*_ENDS[name])
        if name == "br":
            if held:
                held.append(" ")
        elif name not in VOID and len(stack) < DEPTH and not (name in ("html", "body") and any(e.tag == name for e in stack[:2])):
            number += 1
            stack.append(Element(name, attributes, number))
            open_[name] += 1
            hidden += name in HIDDEN
    flush()
    return out
