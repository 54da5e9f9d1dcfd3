"""HTML to leaf blocks: text, tag path and what a labeller sees of them."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass
from functools import lru_cache
from zlib import crc32

import numpy as np

PATH_DIM, WORD_DIM, PLAIN_DIM = 64, 48, 6
DIM = PATH_DIM + WORD_DIM + PLAIN_DIM
#: Element kinds of the HTML standard.
SKIPPED = frozenset("script style noscript template head title svg iframe object textarea select".split())
#: Their content is text up to their end tag or the page's end; the other skipped ones count only where they are closed.
RAW = frozenset("script style title textarea iframe".split())
CLOSED = frozenset("noscript template svg object select".split())
HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title html head".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body br button caption dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html label legend li main nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: An opening tag of these ends an open element of the same kinds, as the standard's optional end tags say.
ENDS = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}}
_TAG = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>")
_START = re.compile(r"<[A-Za-z/!?]")
_ATTR = re.compile(r"(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_NAME = re.compile(r"[A-Za-z]+|[0-9]+")


class Node:
    """An open element: its names, those above it through its parent, and how often each bucket of names occurs on the way down to it, up to 3."""

    __slots__ = ("parent", "tag", "names", "_counts")

    def __init__(self, parent: Node | None, tag: str, names: tuple[str, ...]):
        self.parent, self.tag, self.names, self._counts = parent, tag, names, None

    def path(self) -> tuple[str, ...]:
        out, node = [], self
        while node:
            out.append(node.names)
            node = node.parent
        return tuple(t for names in reversed(out) for t in names)

    def counts(self) -> np.ndarray:
        """Made once for every element, from those of the one above, so deep pages cost no more than flat ones."""
        todo, node = [], self
        while node and node._counts is None:
            todo.append(node)
            node = node.parent
        for at in reversed(todo):
            own = at.parent._counts.copy() if at.parent else np.zeros(PATH_DIM, np.uint8)
            for name in at.names:
                k = _bucket(name, PATH_DIM)
                own[k] = min(3, own[k] + 1)
            at._counts = own
        return self._counts


#: Above all elements.
TOP = Node(None, "", ())


@dataclass
class Leaf:
    text: str
    node: Node | None
    linked: int

    @property
    def path(self) -> tuple[str, ...]:
        return self.node.path() if self.node else ()


class Markup:
    """A page's tags and declarations one after the other, in time that grows with the page alone."""

    def __init__(self, page: str):
        self.page, self.last = page, page.rfind(">")
        self.ends: tuple[np.ndarray, np.ndarray] | None = None

    def after(self, at: int) -> tuple[int, int, re.Match | None]:
        """(start, end, tag) of the next tag, comment or declaration; start is the page's length if there is none."""
        page = self.page
        while m := _START.search(page, at):
            start = m.start()
            if page.startswith("<!--", start):
                close = page.find("-->", start + 4)
                return start, close + 3 if close >= 0 else len(page), None
            if start > self.last:  # nothing ends any more, but for a comment
                at = page.find("<!--", start)
                if at < 0:
                    break
                continue
            if page[start + 1] in "!?":
                return start, page.index(">", start) + 1, None
            if self.ends is None or self._ends_from(start):
                tag = _TAG.match(page, start)
                if tag:
                    return start, tag.end(), tag
                if self.ends is None:
                    self._learn()
            at = start + 1
        return len(page), len(page), None

    def _learn(self) -> None:
        """For each bracket or quote whether a tag that reads on from there ever ends: worked out once, from the page's end."""
        found = [(m.start(), m[0]) for m in re.finditer("[>\"']", self.page)]
        ends = np.zeros(len(found) + 1, bool)
        later: dict[str, int] = {}
        for k in range(len(found) - 1, -1, -1):
            c = found[k][1]
            ends[k] = c == ">" or (c in later and ends[later[c] + 1])
            later[c] = k
        self.ends = np.array([p for p, _ in found]), ends

    def _ends_from(self, start: int) -> bool:
        places, ends = self.ends
        return bool(ends[np.searchsorted(places, start)])


def leaves(page: str | None) -> list[Leaf]:
    """The blocks of text in page order; scripts, styles, the head, comments and markup are none. Null and empty pages have none.

    Broken markup is read as far as it goes: open elements end with the page and stray end tags are passed over.
    """
    page = page or ""
    out: list[Leaf] = []
    stack: list[Node] = []
    open_: dict[str, int] = {}
    parts: list[str] = []
    linked = skipped = at = 0
    where: Node | None = None
    last: dict[str, int] = {}

    def flush() -> None:
        nonlocal linked, where
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Leaf(text, where, linked))
            parts.clear()
        linked, where = 0, None

    def pop() -> None:
        nonlocal skipped
        tag = stack.pop().tag
        open_[tag] -= 1
        skipped -= tag in SKIPPED

    def add(raw: str) -> None:
        nonlocal linked, where
        text = html.unescape(raw)
        parts.append(text)
        if where is None and not text.isspace():
            where = stack[-1] if stack else TOP
        if open_.get("a"):
            linked += len(text)

    markup = Markup(page)
    while at < len(page):
        start, end, m = markup.after(at)
        if start > at and not skipped:
            add(page[at:start])
        at = end
        if not m:
            continue
        tag = m[2].lower()
        # the first tag that cannot be in a head ends it
        if not m[1] and open_.get("head") and tag not in HEAD:
            while open_.get("head"):
                pop()
        if tag in BLOCK:
            flush()
        if m[1]:
            if open_.get(tag):
                while stack[-1].tag != tag:
                    pop()
                pop()
            continue
        if tag in VOID:
            continue
        ends = ENDS.get(tag)
        if ends:
            while stack and stack[-1].tag in ends or (stack and stack[-1].tag not in BLOCK and any(open_.get(e) for e in ends) and _inline_down_to(stack, ends)):
                pop()
        if m[3].rstrip().endswith("/"):
            continue
        if tag in CLOSED:
            # one look ahead a kind: beyond the last end tag none is closed
            if tag not in last:
                last[tag] = max((e.start() for e in re.finditer(rf"</{tag}\s*>", page, re.I)), default=-1)
            if last[tag] < at:
                continue
            close = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = close.end()
            continue
        names = (tag, *_names(tag, m[3])) if m[3] else (tag,)
        stack.append(Node(stack[-1] if stack else None, tag, names))
        open_[tag] = open_.get(tag, 0) + 1
        skipped += tag in SKIPPED
        if tag in RAW:
            close = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = close.end() if close else len(page)
            pop()
    flush()
    return out


def _inline_down_to(stack: list, ends: set[str]) -> bool:
    """Whether only inline elements lie above one that ends here."""
    for tag in (node.tag for node in reversed(stack)):
        if tag in ends:
            return True
        if tag in BLOCK:
            return False
    return False


@lru_cache(20_000)
def _names(tag: str, attrs: str) -> tuple[str, ...]:
    found = []
    for m in _ATTR.finditer(attrs):
        for value in _NAME.findall(m[2] or m[3] or m[4] or ""):
            found += [f".{value.lower()}", f"{tag}.{value.lower()}"]
    return tuple(dict.fromkeys(found))


@lru_cache(200_000)
def _bucket(word: str, dim: int) -> int:
    return crc32(word.encode("utf-8", "surrogatepass")) % dim


def vectors(found: list[Leaf]) -> np.ndarray:
    """A row per leaf: hashed tag path, hashed words, and plain measures."""
    x = np.zeros((len(found), DIM), np.float32)
    for k, leaf in enumerate(found):
        path, node = (), leaf.node
        if node:
            x[k, :PATH_DIM] = node.counts()
        while node and len(path) < 2:
            path, node = (*node.names[len(path) - 2 :], *path), node.parent
        for name in path[-2:]:
            x[k, _bucket("leaf:" + name, PATH_DIM)] += 1.0
        words = leaf.text.lower().split()
        counts = np.bincount([_bucket(w, WORD_DIM) for w in words], minlength=WORD_DIM)
        x[k, PATH_DIM : PATH_DIM + WORD_DIM] = counts / np.sqrt(1 + (counts**2).sum())
        n = len(leaf.text)
        x[k, PATH_DIM + WORD_DIM :] = (
            np.log1p(n) / 8,
            min(1.0, leaf.linked / n),
            leaf.text[-1] in ".!?…:;",
            min(1.0, len(words) / 40),
            k / len(found),
            "©" in leaf.text,
        )
    np.minimum(x[:, :PATH_DIM], 3.0, out=x[:, :PATH_DIM])
    return x
