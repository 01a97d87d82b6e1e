"""Text runs of a stored page with the tags around each of them."""

from __future__ import annotations

import re
from dataclasses import dataclass
from html import unescape

#: Comments and elements whose text isn't shown count as a tag; everything else between < and > is one.
_SPLIT = re.compile(r"(<!--.*?-->|<(?:script|style|noscript)\b.*?</(?:script|style|noscript)\s*>|<[^>]*>)", re.S | re.I)
_TAG = re.compile(r"<\s*(/?)\s*([a-zA-Z][a-zA-Z0-9]*)", re.S)
_MARK = re.compile(r"""\b(?:class|id|role)\s*=\s*["']?([^"'>\s]+)""", re.I)
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: An element that ends an open one of the same kind before it.
_ENDS = {"p": ("p",), "li": ("li", "p"), "tr": ("tr", "td", "th", "p"), "td": ("td", "th", "p"), "th": ("td", "th", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "option": ("option",)}
_BLOCKS = frozenset("div section article main aside nav header footer ul ol table form body h1 h2 h3 h4 h5 h6 blockquote pre dl hr figure p".split())


@dataclass(slots=True)
class Run:
    text: str
    path: tuple[str, ...]
    nodes: tuple[int, ...]


def body_of(html: str) -> str:
    at = html.find("<body")
    if at < 0:
        at = html.lower().find("<body")
    return html[at:] if at >= 0 else html


class _Tags(dict):
    """tag as written -> (closes, name, name with its class, id or role, digits apart, whether it holds what follows,
    whether it ends an open paragraph, the elements that it ends)."""

    def __missing__(self, tag: str):
        m = _TAG.match(tag)
        if not m or tag.startswith("<!") or m[2].lower() in ("script", "style", "noscript"):
            value = None
        else:
            name = m[2].lower()
            mark = _MARK.search(tag)
            label = name + "." + re.sub(r"[\d_\-]+.?$|\d+", "", mark[1].lower()) if mark else name
            value = (bool(m[1]), name, label, name not in _VOID and not tag.endswith("/>"), name in _BLOCKS, _ENDS.get(name))
        if len(self) > 100_000:
            self.clear()
        self[tag] = value
        return value


_tags = _Tags()


def runs_of(html: str) -> list[Run]:
    """The runs of a page in order. Unclosed paragraphs and items end where the next begins, and at the end of what holds them."""
    out: list[Run] = []
    names: list[str] = []
    labels: list[str] = []
    nodes: list[int] = []
    count = 0
    pieces = _SPLIT.split(body_of(html))
    pieces.append("")  # no tag after the last one
    for text, written in zip(pieces[::2], pieces[1::2]):
        if text and not text.isspace():
            out.append(Run(text, tuple(labels), tuple(nodes)))
        tag = _tags[written]
        if tag is None:
            continue
        closes, name, label, holds, block, ends = tag
        last = names[-1] if names else ""
        if closes:
            if name == last:
                names.pop(), labels.pop(), nodes.pop()
            elif name in names:
                at = len(names) - 1 - names[::-1].index(name)
                del names[at:], labels[at:], nodes[at:]
            continue
        if block and last == "p":
            names.pop(), labels.pop(), nodes.pop()
        if ends:
            while names and names[-1] in ends:
                names.pop(), labels.pop(), nodes.pop()
        count += 1
        if holds:
            names.append(name)
            labels.append(label)
            nodes.append(count)
    return out


def texts_of(html: str) -> list[str]:
    """The texts of the runs of a page, without the tags around them."""
    return [piece for piece in _SPLIT.split(body_of(html))[::2] if piece and not piece.isspace()]


def shown(text: str) -> str:
    """A run as a reader sees it: entities resolved, white space as single blanks."""
    return " ".join((unescape(text) if "&" in text else text).split())
