"""A small tree over stdlib HTML events, with the ends of paragraphs and items that authors leave out."""

from __future__ import annotations

from html.parser import HTMLParser

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_CLOSED_BY = {
    "p": frozenset("p div ul ol dl table h1 h2 h3 h4 h5 h6 section article aside nav header footer main form pre blockquote figure hr li".split()),
    "li": frozenset(["li"]), "td": frozenset("td th tr".split()), "th": frozenset("td th tr".split()), "tr": frozenset(["tr"]), "dt": frozenset("dt dd".split()), "dd": frozenset("dt dd".split()), "option": frozenset(["option"]),
}


class Node:
    """An element: its tag, attributes and content, which is text and elements in order."""

    __slots__ = ("tag", "attrs", "content", "parent")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.content, self.parent = tag, attrs, [], parent

    def walk(self):
        """The elements below, in document order."""
        stack = [x for x in reversed(self.content) if isinstance(x, Node)]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(x for x in reversed(node.content) if isinstance(x, Node))

    def strings(self):
        stack = list(reversed(self.content))
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                yield x
            elif x.tag not in ("script", "style", "template"):
                stack.extend(reversed(x.content))

    def text(self) -> str:
        """Words with single blanks between them."""
        return " ".join(" ".join(self.strings()).split())

    def word_count(self) -> int:
        return sum(len(s.split()) for s in self.strings())


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("", {}, None)
        self.at = self.root

    def handle_starttag(self, tag, attrs):
        while self.at.tag in _CLOSED_BY and tag in _CLOSED_BY[self.at.tag]:
            self.at = self.at.parent
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.content.append(node)
        if tag not in _VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.at.content.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag):
        node = self.at
        while node is not None and node.tag != tag:
            node = node.parent
        if node is not None and node.parent is not None:
            self.at = node.parent

    def handle_data(self, data):
        self.at.content.append(data)


def parse(html: str) -> Node:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.root
