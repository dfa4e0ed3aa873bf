"""HTML as a sequence of template tokens and text blocks, for operator 12.

One pass over the page: tags by a pattern, elements on a stack that closes what HTML closes by
itself.  A token is a block-level tag or a whole text block, each hashed with the path of
block-level elements above it, so equal tags in different places are different tokens.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from dataclasses import dataclass, field

import xxhash

# Element names of the HTML standard.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base basefont br col embed frame hr img input keygen link meta param source track wbr".split())
RAW = frozenset("iframe noembed noframes noscript script style textarea title xmp".split())
HIDDEN = frozenset("audio button canvas datalist head math map meter object progress select svg template video".split())
#: Elements that an opening tag ends, and those that it does not look beyond.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}),
    "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot"}, {"table"}), "thead": ({"tbody", "thead", "tfoot"}, {"table"}), "tfoot": ({"tbody", "thead", "tfoot"}, {"table"}),
    "option": ({"option"}, {"select", "datalist", "optgroup"}), "body": ({"head"}, {"body"}),
}
# What parts of pages are called. The second list counts outside an article only.
AROUND = frozenset("aside footer form menu nav dialog search".split())
AROUND_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())
AROUND_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo menu nav navbar navigation breadcrumb breadcrumbs pagination pager sidebar footer notice notices cookie cookies consent gdpr popup modal comment comments commentlist disqus".split()
)
AROUND_OUTSIDE = frozenset("header masthead banner topbar toolbar widget widgets related recommended share sharing social newsletter subscribe login signup".split())
COMMENT_WORDS = frozenset("comment comments commentlist reply replies".split())
#: Elements beyond this depth are not kept apart (browsers stop there, too).
DEPTH = 512

_TAG = re.compile(r"<(?:!--|(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+(?:\"[^\"]*\"|'[^']*')?)*+)(?:>|\Z)|[!?/][^>]*(?:>|\Z))")
_COMMENT_END = re.compile(r"--!?>|\Z")
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")
_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
_DIGITS = re.compile(r"\d+")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I) for name in RAW}


def _hash(text: str, seed: int) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), seed)


@dataclass
class Block:
    """A text block: its token's position, the text that is not around the article, and whether it
    is in an article; ``size`` and ``linked`` are characters, those in links among them."""

    at: int
    text: str
    main: bool
    size: int
    linked: int


@dataclass
class Page:
    tokens: list[int] = field(default_factory=list)
    blocks: list[Block] = field(default_factory=list)

    @property
    def marked(self) -> bool:
        """Whether the page says where its article is."""
        return any(b.main and b.text for b in self.blocks)


@dataclass(slots=True)
class _Open:
    name: str
    path: int
    hidden: bool
    around: bool
    main: bool
    block: bool


def _traits(name: str, attributes: str, main: bool) -> tuple[bool, bool, bool, str]:
    """(hidden, around, main, label for the path) of an element."""
    found: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(attributes) if attributes else ():
        found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    role = found.get("role", "").strip().lower()
    named = f"{found.get('class', '')} {found.get('id', '')}"
    words = {w.lower() for w in _WORD.findall(named)}
    hidden = name in HIDDEN or "hidden" in found or "display:none" in found.get("style", "").replace(" ", "").lower()
    is_main = name in ("article", "main") or role == "main" or "articlebody" in found.get("itemprop", "").lower()
    if name in ("html", "body"):
        around = False
    elif is_main:
        around = bool(words & COMMENT_WORDS)
    else:
        around = name in AROUND or role in AROUND_ROLES or bool(words & AROUND_WORDS) or (not main and (name == "header" or bool(words & AROUND_OUTSIDE)))
    return hidden, around, is_main, _DIGITS.sub("#", f"{name} {' '.join(named.split())}")


class _Reader:
    def __init__(self, cache: dict):
        self.page, self.cache = Page(), cache
        self.stack: list[_Open] = []
        self.names: Counter[str] = Counter()
        self.deeper: Counter[str] = Counter()
        self.hidden = self.around = self.main = self.links = 0
        self.whole: list[str] = []
        self.kept: list[str] = []
        self.linked = 0
        self.path = 0

    def text(self, raw: str) -> None:
        if raw and not self.hidden:
            if "&" in raw:
                raw = entities.unescape(raw)
            self.whole.append(raw)
            if self.links:
                self.linked += len("".join(raw.split()))
            if not self.around:
                self.kept.append(raw)

    def flush(self) -> None:
        if self.whole:
            whole = " ".join("".join(self.whole).split())
            if whole:
                text = whole if len(self.kept) == len(self.whole) else " ".join("".join(self.kept).split())
                self.page.blocks.append(Block(len(self.page.tokens), text, self.main > 0, len(whole.replace(" ", "")), self.linked))
                self.page.tokens.append(_hash(whole, self.path ^ 1))
            self.whole, self.kept, self.linked = [], [], 0

    def drop(self, at: int) -> None:
        e = self.stack.pop(at)
        self.names[e.name] -= 1
        self.hidden -= e.hidden
        self.around -= e.around
        self.main -= e.main
        self.links -= e.name == "a"

    def close_top(self) -> None:
        e = self.stack[-1]
        if e.block:
            self.flush()
            self.page.tokens.append(e.path ^ 2)
        self.drop(-1)
        if e.block:
            self.path = next((x.path for x in reversed(self.stack) if x.block), 0)

    def close_through(self, at: int) -> None:
        while len(self.stack) > at:
            self.close_top()

    def open(self, name: str, attributes: str) -> None:
        block = name in BLOCK
        if block:
            self.flush()
            if self.names["p"]:
                self.end({"p"}, BLOCK - {"p"})
            if self.names["head"] and name not in ("head", "html"):
                self.end({"head"}, {"body"})
        if name in ENDS and any(self.names[x] for x in ENDS[name][0]):
            self.end(*ENDS[name])
        if name in VOID:
            if name == "br":
                self.text(" ")
            return
        if len(self.stack) >= DEPTH:
            self.deeper[name] += 1
            return
        key = (name, attributes, self.path, self.main > 0)
        known = self.cache.get(key)
        if known is None:
            hidden, around, main, label = _traits(name, attributes, self.main > 0)
            known = hidden, around, main, _hash(label, self.path) & ~3 if block else self.path
            if len(self.cache) > 20_000:
                self.cache.clear()
            if len(attributes) < 200:
                self.cache[key] = known
        hidden, around, main, path = known
        self.stack.append(_Open(name, path, hidden, around, main, block))
        self.names[name] += 1
        self.hidden += hidden
        self.around += around
        self.main += main
        self.links += name == "a"
        if block:
            self.path = path
            self.page.tokens.append(path)

    def end(self, those: set[str], beyond: set[str] | frozenset[str]) -> None:
        """Closes the innermost of ``those`` unless one of ``beyond`` is nearer."""
        for at in range(len(self.stack) - 1, -1, -1):
            name = self.stack[at].name
            if name in those:
                self.close_through(at)
                return
            if name in beyond:
                return

    def close(self, name: str) -> None:
        if self.deeper[name]:
            self.deeper[name] -= 1
        elif name == "br":
            self.text(" ")
        elif self.names[name]:
            at = len(self.stack) - 1
            while self.stack[at].name != name:
                at -= 1
            if name in BLOCK:
                self.close_through(at)
            else:  # what overlaps an inline element stays open
                self.drop(at)
        elif name in BLOCK:
            self.flush()

    def read(self, html: str) -> Page:
        at = 0
        while m := _TAG.search(html, at):
            self.text(html[at : m.start()])
            at = m.end()
            name = m[2]
            if name is None:
                if m[0] == "<!--":
                    at = at + 1 if html.startswith(">", at) else at + 2 if html.startswith("->", at) else _COMMENT_END.search(html, at).end()
                continue
            name = name.lower()
            if m[1]:
                self.close(name)
            elif name in RAW:
                end = _RAW_END[name].search(html, at)
                at = end.end() if end else len(html)
            else:
                self.open(name, m[3])
        self.text(html[at:])
        self.flush()
        return self.page


def read_page(html: str | None, cache: dict | None = None) -> Page:
    return _Reader({} if cache is None else cache).read(html or "")
