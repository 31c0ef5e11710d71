"""HTML text to an element tree: the one step Spark's functions cannot express.

``read_tree`` is a small per-page helper; ``with_dom`` runs it over Arrow batches and
keeps every other column in the JVM. The tree is one row's array, so selecting from
it later needs no shuffle and no second pass through Python.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dateline.schemas import DOM

# HTML tag classes, as the HTML standard and common parsers have them.
VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
BLOCK = frozenset(
    "html head body frameset script noscript style meta link title frame noframes section nav "
    "aside hgroup header footer p h1 h2 h3 h4 h5 h6 ul ol pre div blockquote hr address figure "
    "figcaption form fieldset ins del dl dt dd li table caption thead tfoot tbody colgroup col "
    "tr th td video audio canvas details menu plaintext template article main svg math center "
    "dir applet marquee listing summary".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li listing main menu nav ol p "
    "plaintext pre search section summary table ul".split()
)
SCOPE = frozenset("html table caption td th template button object applet marquee".split())
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
# Opening the key closes an open element of the first set, found before the second.
IMPLIED_END = {
    "li": ({"li"}, SCOPE | {"ul", "ol", "menu", "dir"}),
    "dd": ({"dd", "dt"}, SCOPE | {"dl"}),
    "dt": ({"dd", "dt"}, SCOPE | {"dl"}),
    "option": ({"option"}, SCOPE | {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, SCOPE | {"select"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr"}, {"tbody", "thead", "tfoot", "table"}),
    "tbody": ({"tbody", "thead", "tfoot"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot"}, {"table"}),
    "a": ({"a"}, SCOPE),
}
PRESERVED = frozenset({"pre", "textarea"})
NO_TEXT = frozenset({"script", "style"})
RAW = NO_TEXT | {"xmp", "iframe", "noembed", "noframes"}
RAW_WITH_ENTITIES = frozenset({"title", "textarea"})

# Of unclosed formatting elements that are equal only so many go on in later blocks, and
# of all kinds together only so many; else elements would grow with the page's square.
MOST_EQUAL = 3
MOST_REOPENED = 12

# Characters of markup whose trees are Python objects at a time.
HELD = 1 << 18

_TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*+>"
    r"|<(/?)([A-Za-z][^\s/>]*+)"
    r"((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+)?+)*+)>",
    re.S,
)
_CUT_OFF = re.compile("<[A-Za-z/!?]")
_ATTR = re.compile(r"([^\s/>=]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]*))?")
_RAW_END = {
    tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>|\Z", re.I) for tag in RAW | RAW_WITH_ENTITIES
}
# Runs of white space, but for the commonest, a single blank, which needs no change.
_BLANKS = re.compile("[\t\n\f\r\xa0][ \t\n\f\r\xa0]*| [ \t\n\f\r\xa0]+")
_HIDDEN = (chr(0x200B), chr(0xAD))  # zero-width space, soft hyphen
# In attributes a reference without its semicolon is literal before "=" or a letter.
_ATTR_REF = re.compile(r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z0-9]+;|[A-Za-z0-9]+(?![A-Za-z0-9=]))")


def _attributes(source: str) -> list[tuple[str, str]]:
    found: dict[str, str] = {}
    for name, value in _ATTR.findall(source):
        if value[:1] in ("'", '"'):
            value = value[1:-1]
        if "&" in value:
            value = _ATTR_REF.sub(lambda m: unescape(m.group()), value)
        found.setdefault(name.lower(), value)
    return list(found.items())


class _Tree:
    """Open elements and the page text gathered so far."""

    def __init__(self) -> None:
        self.parent: list[int] = []
        self.last: list[int] = []
        self.tag: list[str] = []
        self.attrs: list[list[tuple[str, str]]] = []
        self.lo: list[int] = []
        self.hi: list[int] = []
        self.open: list[int] = []
        self.after_block: list[bool] = [False]
        self.formatting: list[tuple[str, list[tuple[str, str]]]] = []
        self.count: Counter[str] = Counter()  # open elements by tag
        self.live = 0  # open formatting elements
        self.chunks: list[str] = []
        self.size = 0
        self.blank_end = True
        self.preserving = 0

    def _emit(self, text: str) -> None:
        if text:
            self.chunks.append(text)
            self.size += len(text)
            self.blank_end = text[-1] == " "

    def _gap(self) -> None:
        if self.size and not self.blank_end:
            self._emit(" ")

    def _next_sibling(self) -> None:
        if self.after_block[-1]:
            self._gap()
            self.after_block[-1] = False

    def push(self, tag: str, attrs: list[tuple[str, str]]) -> None:
        self._next_sibling()
        if tag in BLOCK or tag == "br":
            self._gap()
        index = len(self.tag)
        self.parent.append(self.open[-1] if self.open else -1)
        self.last.append(index)
        self.tag.append(tag)
        self.attrs.append(attrs)
        self.lo.append(self.size)
        self.hi.append(self.size)
        if tag not in VOID:
            self.open.append(index)
            self.after_block.append(False)
            self.preserving += tag in PRESERVED
            self.count[tag] += 1
            self.live += tag in FORMATTING
        elif tag in BLOCK:
            self.after_block[-1] = True

    def pop(self) -> None:
        index = self.open.pop()
        self.after_block.pop()
        self.hi[index] = self.size
        self.last[index] = len(self.tag) - 1
        tag = self.tag[index]
        self.preserving -= tag in PRESERVED
        self.count[tag] -= 1
        self.live -= tag in FORMATTING
        if self.tag[index] in BLOCK:
            self.after_block[-1] = True

    def depth_of(self, tags: frozenset[str] | set[str], barrier: frozenset[str] | set[str]) -> int:
        """Position among the open elements, or -1 behind a barrier."""
        if not any(self.count[tag] for tag in tags):
            return -1
        for depth in range(len(self.open) - 1, -1, -1):
            tag = self.tag[self.open[depth]]
            if tag in tags:
                return depth
            if tag in barrier:
                return -1
        return -1

    def close(self, tags: frozenset[str] | set[str], barrier: frozenset[str] | set[str]) -> None:
        depth = self.depth_of(tags, barrier)
        while 0 <= depth < len(self.open):
            self.pop()

    def reopen_formatting(self) -> None:
        """Formatting cut off by its block's end goes on in the next block."""
        for tag, attrs in self.formatting[max(self.live, len(self.formatting) - MOST_REOPENED) :]:
            self.push(tag, attrs)

    def remember(self, tag: str, attrs: list[tuple[str, str]]) -> None:
        """Add to the formatting that goes on, forgetting the oldest of too many."""
        if self.formatting.count((tag, attrs)) >= MOST_EQUAL:
            self.formatting.remove((tag, attrs))
        elif len(self.formatting) >= MOST_REOPENED:
            del self.formatting[0]
        self.formatting.append((tag, attrs))

    def start(self, tag: str, attrs: list[tuple[str, str]]) -> None:
        if tag in ("html", "body") and self.count[tag]:
            return
        if tag in CLOSES_P:
            self.close({"p"}, SCOPE)
        if tag in IMPLIED_END:
            ended, barrier = IMPLIED_END[tag]
            self.close(ended, barrier)
            if tag == "a":
                self.formatting = [f for f in self.formatting if f[0] != "a"]
        if self.open and tag in ("tr",) and self.tag[self.open[-1]] == "table":
            self.push("tbody", [])
        if tag not in BLOCK and tag not in RAW:
            self.reopen_formatting()
        self.push(tag, attrs)
        if tag in FORMATTING:
            self.remember(tag, attrs)

    def end(self, tag: str) -> None:
        if tag in FORMATTING:
            for position in range(len(self.formatting) - 1, -1, -1):
                if self.formatting[position][0] == tag:
                    del self.formatting[position]
                    break
            self.close({tag}, BLOCK)
        elif tag == "p" and self.depth_of({"p"}, SCOPE) < 0:
            self.start("p", [])
            self.pop()
        elif tag == "br":
            self.start("br", [])
        else:
            self.close({tag}, {"td", "th", "caption", "table", "template"} - {tag}
                       if tag not in ("table", "tr", "tbody", "thead", "tfoot") else {"template"})

    def text(self, source: str, decode: bool = True) -> None:
        if decode and "&" in source:
            source = unescape(source)
        if not self.open and not source.strip():
            return
        if self.preserving:
            self._next_sibling()
            self._emit(source)
            return
        for hidden in _HIDDEN:
            if hidden in source:
                source = source.replace(hidden, "")
        source = _BLANKS.sub(" ", source)
        if source != " ":
            self.reopen_formatting()
        self._next_sibling()
        self._emit(source[1:] if self.blank_end and source[:1] == " " else source)


def read_tree(html: str | None) -> _Tree:
    """Build the element tree of one page."""
    tree = _Tree()
    html = html or ""
    at, last = 0, html.rfind(">") + 1
    while True:
        # Nothing ends behind the last ">", so the search for a tag's end stops there.
        token = _TOKEN.search(html, at, last) if at < last else None
        if token is None:
            tail = _CUT_OFF.split(html[at:], maxsplit=1)[0]
            if tail:
                tree.text(tail)
            break
        if token.start() > at:
            tree.text(html[at : token.start()])
        at = token.end()
        tag = token.group(2)
        if tag is None:
            continue
        tag = tag.lower()
        if token.group(1):
            tree.end(tag)
            continue
        tree.start(tag, _attributes(token.group(3)) if token.group(3) else [])
        if tag in _RAW_END:
            stop = _RAW_END[tag].search(html, at)
            if tag not in NO_TEXT and stop.start() > at:
                tree.text(html[at : stop.start()], decode=tag in RAW_WITH_ENTITIES)
            tree.pop()
            at = stop.end()
    while tree.open:
        tree.pop()
    return tree


def _arrays(trees: list[_Tree]) -> pa.StructArray:
    """The trees as Arrow memory."""
    texts: list[str] = []
    el_ends, attr_ends = [0], [0]
    parent: list[int] = []
    last: list[int] = []
    tag: list[str] = []
    lo: list[int] = []
    hi: list[int] = []
    keys: list[str] = []
    values: list[str] = []
    for tree in trees:
        texts.append("".join(tree.chunks))
        parent += tree.parent
        last += tree.last
        tag += tree.tag
        lo += tree.lo
        hi += tree.hi
        for pairs in tree.attrs:
            for key, value in pairs:
                keys.append(key)
                values.append(value)
            attr_ends.append(len(keys))
        el_ends.append(len(parent))
    attr_items = pa.StructArray.from_arrays(
        [pa.array(keys, pa.string()), pa.array(values, pa.string())], names=["k", "v"]
    )
    attrs = pa.ListArray.from_arrays(pa.array(attr_ends, pa.int32()), attr_items)
    elements = pa.StructArray.from_arrays(
        [
            pa.array(parent, pa.int32()),
            pa.array(last, pa.int32()),
            pa.array(tag, pa.string()),
            attrs,
            pa.array(lo, pa.int32()),
            pa.array(hi, pa.int32()),
        ],
        names=["parent", "last", "tag", "attrs", "lo", "hi"],
    )
    return pa.StructArray.from_arrays(
        [
            pa.array(texts, pa.string()),
            pa.ListArray.from_arrays(pa.array(el_ends, pa.int32()), elements),
        ],
        names=["text", "els"],
    )


def _pieces(html: pa.Array) -> Iterator[pa.Array]:
    """The trees of a batch, in order. As Python objects, many times larger than as Arrow memory,
    only ``HELD`` characters of markup, or one longer page, are there at a time."""
    trees: list[_Tree] = []
    held = 0
    for page in html:
        markup = page.as_py()
        trees.append(read_tree(markup))
        held += len(markup or "")
        if held >= HELD:
            piece, trees, held = _arrays(trees), [], 0
            yield piece
    if trees:
        yield _arrays(trees)


def _doms(html: pa.Array) -> pa.Array:
    """The trees of a whole batch."""
    return pa.concat_arrays([_arrays([]), *_pieces(html)])


_dom = F.arrow_udf(_doms, DOM)


@F.arrow_udf(DOM)
def _streamed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Each piece goes back to the JVM before the next is read, so of a batch only the markup is held."""
    for html in batches:
        yield from _pieces(html)


def dom_of(html: Column) -> Column:
    """The page's text and element array."""
    return _streamed(html)


def with_dom(pages: DataFrame, html: str = "html") -> DataFrame:
    """Replace the markup column by ``dom``; map-only."""
    return pages.withColumn("dom", dom_of(F.col(html))).drop(html)


def element_text(dom: Column, element: Column) -> Column:
    """Text of an element and all below it, white space collapsed."""
    return F.trim(F.substr(dom["text"], element["lo"] + 1, element["hi"] - element["lo"]))


def elements(pages_with_dom: DataFrame, *keys: str) -> DataFrame:
    """One row per element: ``idx``, ``parent_idx``, ``tag``, ``attrs``, ``text``.

    The outer form keeps Spark from testing for empty pages below the parser, which
    would parse every page twice.
    """
    exploded = F.posexplode_outer("dom.els").alias("idx", "el")
    rows = pages_with_dom.select(*keys, "dom", exploded).where("idx is not null")
    return rows.select(
        *keys,
        "idx",
        F.col("el.parent").alias("parent_idx"),
        F.col("el.tag").alias("tag"),
        F.col("el.attrs").alias("attrs"),
        element_text(F.col("dom"), F.col("el")).alias("text"),
    )
