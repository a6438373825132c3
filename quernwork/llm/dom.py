"""Pages as trees: elements with their parents, what is written in them, and features.

A small reader over the standard library's tokens: it closes elements that HTML closes by
itself, gives each piece of text its block, and leaves out what is never text.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np

# Names of HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = set("script style noscript template title svg math iframe object canvas textarea select option button datalist".split())
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q ruby rb rp rt s samp "
    "small span strike strong sub sup time tt u var".split()
)
# Elements that a start tag of the same kind ends, up to the nearest element around.
ITEMS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th")}
AROUND = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}}
# Elements that stand in a paragraph only after it has ended.
ENDS_P = set(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 "
    "h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()
)
TAGS = (
    "html body div section article main p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table tr td th blockquote pre figure "
    "figcaption a b i em strong span nav header footer aside form label fieldset ins center address dialog details"
).split()
# What words of class, id and role say of an element.
SAYS = {
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager toc skip tabs topnav subnav",
    "header": "header masthead topbar banner hdr branding logo",
    "footer": "footer foot copyright colophon legal contentinfo bottom",
    "side": "sidebar aside rail widget widgets related recommended recommendations trending popular complementary more",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe paywall toast "
    "notification warning disclaimer message",
    "advert": "ad ads adv advert advertisement advertising sponsor sponsored promo promoted promotion dfp adsbygoogle outbrain taboola",
    "share": "share sharing social follow tags byline author meta metadata tools toolbar rating",
    "comment": "comment comments commentlist reply replies respond disqus discussion thread feedback reader",
    "form": "form search login signin signup register contact",
    "hidden": "hidden invisible screenreader",
    "content": "article articlebody content main post entry story body text prose page paragraph maincontent",
}
GROUPS = list(SAYS)
_SAID = {word: i for i, words in enumerate(SAYS.values()) for word in words.split()}
_CONTENT = 1 << GROUPS.index("content")
_TAG = {tag: i for i, tag in enumerate(TAGS)}
# Kinds of parent-child edges, by the child; one whose tag or name says what it is stands out.
KINDS = ("inline", "text", "item", "section", "named", "main")
_NAMED = set("nav header footer aside form dialog".split())
_TEXT = set("p h1 h2 h3 h4 h5 h6 pre blockquote figcaption figure".split())
_ITEM = set("li dt dd tr td th tbody thead tfoot ul ol dl table".split())

_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_MARKS = str.maketrans("", "", ".,;:!?")


def kind_of(tag: str, said: int) -> int:
    if tag in _NAMED or said & ~_CONTENT:
        return 4
    if said or tag in ("article", "main"):
        return 5
    if tag in INLINE:
        return 0
    return 1 if tag in _TEXT else 2 if tag in _ITEM else 3


class Tree(HTMLParser):
    """The elements of a page in their order, and its texts with element and block."""

    def __init__(self, page: str) -> None:
        super().__init__(convert_charrefs=True)
        self.parent, self.depth, self.tags, self.said, self.label = [-1], [0], ["html"], [0], [0]
        self.texts: list[tuple[int, int, str]] = []
        self.block = 0
        # The open elements: tag, node (-1 in what is not text), nearest open p, item and block element.
        self.open: list[tuple[str, int, int, dict[str, int], int]] = [("html", 0, -1, {}, 0)]
        self.places: dict[str, list[int]] = {"html": [0]}
        self.feed(page)
        self.close()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in VOID:
            if tag == "hr":
                self._end_p()
                self.block += 1
            elif tag == "br" and self.open[-1][1] >= 0:
                self.texts.append((self.block, self.open[-1][1], " "))
            return
        if tag in ("html", "body", "head") and tag in self.places:
            return
        if tag in ENDS_P:
            self._end_p()
        items = self.open[-1][3]
        if tag in ITEMS:
            at = max((items.get(t, -1) for t in ITEMS[tag]), default=-1)
            if at >= 0:
                self._pop_to(at)
                items = self.open[-1][3]
        _, above, p, _, block = self.open[-1]
        here = len(self.open)
        node = -1 if above < 0 or tag in UNSEEN else len(self.tags)
        if tag in INLINE:
            pass
        else:
            self.block += 1
            block = here
            p = here if tag == "p" else -1
            if tag in ITEMS or tag in ("ul", "ol", "menu", "dl", "table"):
                items = {t: v for t, v in items.items() if tag not in AROUND[t]}
                if tag in ITEMS:
                    items[tag] = here
        self.open.append((tag, node, p, items, block))
        self.places.setdefault(tag, []).append(here)
        if node >= 0:
            self._node(tag, above, attrs)

    def _node(self, tag: str, above: int, attrs: list[tuple[str, str | None]]) -> None:
        said, label = 0, self.label[above]
        for name, value in attrs:
            if name in ("class", "id", "role") and value:
                for word in _WORDS.findall(value):
                    i = _SAID.get(word.lower())
                    if i is not None:
                        said |= 1 << i
            elif name == "hidden" or name == "aria-hidden" and value == "true":
                said |= 1 << _SAID["hidden"]
            elif name == "style" and value and "display:none" in value.replace(" ", ""):
                said |= 1 << _SAID["hidden"]
            elif name == "data-main" and value in ("0", "1"):
                label = int(value)
        self.parent.append(above)
        self.depth.append(self.depth[above] + 1)
        self.tags.append(tag)
        self.said.append(said)
        self.label.append(label)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        # A slash at the end of a start tag says nothing in HTML.
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        places = self.places.get(tag)
        if not places or tag in ("html", "body"):
            return
        if tag in INLINE and places[-1] < self.open[-1][4]:
            return
        self._pop_to(places[-1])

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """Where a declaration in brackets ends: outside XML at the first angle, whatever it says."""
        return self.rawdata.find(">", i + 3) + 1 or -1

    def handle_data(self, data: str) -> None:
        node = self.open[-1][1]
        if node >= 0:
            self.texts.append((self.block, node, data))

    def _end_p(self) -> None:
        if self.open[-1][2] >= 0:
            self._pop_to(self.open[-1][2])

    def _pop_to(self, at: int) -> None:
        while len(self.open) > at:
            tag = self.open.pop()[0]
            places = self.places[tag]
            places.pop()
            if not places:
                del self.places[tag]
            if tag not in INLINE:
                self.block += 1


class Forest:
    """Several trees as one set of arrays; parents come before their children."""

    def __init__(self, trees: list[Tree]) -> None:
        sizes = [len(t.tags) for t in trees]
        self.start = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        join = lambda lists: [x for part in lists for x in part]
        shift = np.repeat(self.start[:-1], sizes)
        own = np.array(join(t.parent for t in trees), np.int64)
        self.parent = np.where(own < 0, -1, own + shift)
        self.depth = np.array(join(t.depth for t in trees), np.int64)
        tags = join(t.tags for t in trees)
        self.tag = np.array([_TAG.get(t, len(TAGS)) for t in tags], np.int64)
        said = join(t.said for t in trees)
        self.kind = np.array([kind_of(t, x) for t, x in zip(tags, said)], np.int64)
        self.said = np.array(said, np.int64)
        self.label = np.array(join(t.label for t in trees), np.int64)
        order = np.argsort(self.depth, kind="stable")
        cuts = np.searchsorted(self.depth[order], np.arange(self.depth.max(initial=0) + 2))
        # The nodes of each depth, from the roots down.
        self.levels = [order[a:b] for a, b in zip(cuts, cuts[1:])]
        n = len(self.parent)
        self.chars, self.marks = np.zeros(n), np.zeros(n)
        for start, tree in zip(self.start.tolist(), trees):
            for _, node, text in tree.texts:
                bare = "".join(text.split())
                if bare:
                    self.chars[start + node] += len(bare)
                    self.marks[start + node] += len(bare) - len(bare.translate(_MARKS))

    def below(self, values: np.ndarray) -> np.ndarray:
        """Sums of values over each node and all below it."""
        out = values.astype(np.float64)
        for level in self.levels[:0:-1]:
            np.add.at(out, self.parent[level], out[level])
        return out

    def features(self) -> np.ndarray:
        """Of each node: its tag, what its names say, and the text in it and below."""
        n = len(self.parent)
        tags = np.zeros((n, len(TAGS) + 1))
        tags[np.arange(n), self.tag] = 1
        groups = (self.said[:, None] >> np.arange(len(GROUPS)) & 1).astype(np.float64)
        chars, marks = self.below(self.chars), self.below(self.marks)
        linked = self.below(np.where(self.tag == _TAG["a"], chars, 0))
        some = np.maximum(chars, 1)
        text = np.stack(
            [
                np.ones(n),
                # Beyond some length, more text says no more.
                np.minimum(np.log1p(self.chars), 6) / 5,
                np.minimum(np.log1p(chars), 9) / 8,
                np.minimum(linked / some, 1),
                np.minimum(20 * marks / some, 2),
                chars == 0,
            ],
            axis=1,
        )
        return np.hstack([tags, groups, text])


def blocks(texts: list[tuple[int, int, str]], keep: list[bool]) -> str:
    """The kept texts, white space as single spaces, a line for each block that has any."""
    out, current, parts = [], None, []
    for block, node, text in texts:
        if not keep[node]:
            continue
        if block != current:
            if parts:
                out.append("".join(parts))
            current, parts = block, []
        parts.append(text)
    if parts:
        out.append("".join(parts))
    lines = (" ".join(line.split()) for line in out)
    return "\n".join(line for line in lines if line)
