"""A forgiving HTML reader: elements as a tree, and text in blocks. Its time is linear in the page, however malformed."""

from __future__ import annotations

import html
import re
from collections import Counter

#: A tag whose quoted values are closed, and one up to the next angle bracket. Neither ever goes back over what it read.
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_OPENER = re.compile(r"</?[a-zA-Z]")
_SHORT = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_NAME = re.compile(r"(?:class|id|role)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++))", re.I)
#: Elements by the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template noscript textarea title iframe svg object select".split())
#: Those of them that reach to the end of the page if they aren't closed; of the others only the tag is left out then.
TO_END = frozenset("script style textarea title iframe".split())
INLINE = frozenset("a abbr b bdi bdo cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strong sub sup time tt u var".split())
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
}
STOPS = frozenset("ul ol dl table article section div main body html nav aside footer header form".split())
_ENDS = {t: re.compile(rf"</{t}\s*+>", re.I) for t in RAW}


class _Open:
    """The open elements. Counts by name say whether a search through them will find something, so each search ends by
    closing what it passed."""

    def __init__(self, page: Page):
        self.page, self.stack = page, [0]
        self.blocks = [0]  # those that aren't inline
        self.all: Counter[str] = Counter()
        self.inline = [Counter()]  # names of the inline ones since each block
        self.scope = [Counter()]  # names since each element of STOPS
        self.links = 0

    def push(self, e: int) -> None:
        tag = self.page.tag[e]
        self.stack.append(e)
        self.all[tag] += 1
        self.links += tag == "a"
        if tag in INLINE:
            self.inline[-1][tag] += 1
        else:
            self.blocks.append(e)
            self.inline.append(Counter())
        if tag in STOPS:
            self.scope.append(Counter())
        else:
            self.scope[-1][tag] += 1

    def pop(self) -> str:
        tag = self.page.tag[self.stack.pop()]
        self.all[tag] -= 1
        self.links -= tag == "a"
        if tag in INLINE:
            self.inline[-1][tag] -= 1
        else:
            self.blocks.pop()
            self.inline.pop()
        if tag in STOPS:
            self.scope.pop()
        else:
            self.scope[-1][tag] -= 1
        return tag

    def close(self, tag: str) -> None:
        """By an end tag: up to the last such element, but an inline one only inside its block."""
        if self.inline[-1][tag] if tag in INLINE else self.all[tag]:
            while self.pop() != tag:
                pass

    def make_room(self, tag: str) -> None:
        """What a start tag of a block closes: an open paragraph, and the items that it can't be in."""
        shut = CLOSES.get(tag)
        while (p := self.scope[-1]["p"]) or (shut and any(self.scope[-1][t] for t in shut)):
            while True:
                last = self.pop()
                if (last == "p" and p) or (shut and last in shut):
                    break
            if not shut or last != "p":
                return


class Page:
    """Elements in page order: tag, parent, names (of class, id and role, lower case), and lengths of own text and of text
    in links. blocks: (element, text), white space made single, references decoded.

    A tag with a quote that nothing closes ends at the next angle bracket; one that nothing ends is text. Null bytes and
    any nesting are read as they come."""

    __slots__ = ("tag", "parent", "names", "own", "linked", "blocks")

    def __init__(self, source: str):
        self.tag, self.parent, self.names = ["#page"], [-1], [""]
        self.blocks: list[tuple[int, str]] = []
        tree = _Open(self)
        pieces: list[str] = []
        linked = [0]
        at, n, holder = 0, len(source), 0
        unclosed: set[str] = set()  # from here on
        whole_quotes = ends = True  # whether quotes, and tags, are still known to be closed further on

        def flush() -> None:
            nonlocal pieces
            if pieces:
                text = " ".join(html.unescape("".join(pieces)).split())
                if text:
                    self.blocks.append((holder, text))
                pieces = []

        def say(text: str) -> None:
            nonlocal holder
            if text:
                if not pieces:
                    holder = tree.blocks[-1]
                pieces.append(text)
                if tree.links:
                    linked[holder] += len(text.strip())

        while at < n:
            start, look, m = -1, at, None
            while ends:
                start = source.find("<", look)
                if start < 0 or source.startswith(("<!", "<?"), start):
                    break
                m = _TAG.match(source, start) if whole_quotes else None
                if not m and _OPENER.match(source, start):
                    whole_quotes = False
                    m = _SHORT.match(source, start)
                    ends = m is not None
                if m:
                    break
                look = start + 1
            if not ends or start < 0:
                say(source[at:])
                break
            say(source[at:start])
            if not m:
                comment = source.startswith("<!--", start)
                end = source.find("-->" if comment else ">", start + 4 if comment else start)
                if end < 0:
                    if not comment:
                        ends = False
                        at = start
                        continue
                    break
                at = end + (3 if comment else 1)
                continue
            at = m.end()
            tag = m[2].lower()
            if m[1]:
                if tag not in INLINE:
                    flush()
                tree.close(tag)
                continue
            if tag in RAW:
                if tag not in unclosed and (not m[3].rstrip().endswith("/") or tag not in ("svg", "object")):
                    if end := _ENDS[tag].search(source, at):
                        at = end.end()
                    elif tag in TO_END:
                        at = n
                    else:
                        unclosed.add(tag)
                continue
            if tag in VOID:
                if tag in ("br", "hr"):
                    pieces.append(" ") if pieces else None
                if tag == "hr":
                    flush()
                continue
            if tag not in INLINE:
                flush()
                tree.make_room(tag)
            e = len(self.tag)
            found = _NAME.findall(m[3]) if m[3] else ()
            self.tag.append(tag)
            self.parent.append(tree.stack[-1])
            self.names.append(" ".join(a or b or c for a, b, c in found).lower())
            linked.append(0)
            tree.push(e)
        flush()
        self.own = [0] * len(self.tag)
        for e, text in self.blocks:
            self.own[e] += len(text)
        self.linked = linked
