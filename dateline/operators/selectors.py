"""CSS selectors matched inside each page's row, so selecting needs no shuffle.

Supported: ``tag``, ``*``, ``.class``, ``#id``, ``[a]``, ``[a=v]``, ``[a!=v]``,
``[a^=v]``, ``[a$=v]``, ``[a*=v]``, ``[a~=regex]`` (values quoted or not), several of
them on one element, children ``x > y``, descendants ``x y``, chains of both, and groups
``x, y`` of such chains. Anything else is refused: ``css`` raises, ``compiled`` gives null.

A chain is cut at its descents into links of child steps. A link's elements are found by
climbing from the innermost step. What lies below the elements of the link before is read
off their intervals, ``idx`` to ``last``: the outermost ones are disjoint and in document
order, so the elements below them are visited once, and an element's chain lies below
exactly when its top comes after the outermost element. Groups are a union in document order.

A literal selector becomes plain Column tests. A column of selectors, joined in from
a site table, is compiled to rows of steps and matched by the same tests as data.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dateline.functions.text import java_trim
from dateline.operators.markup import element_text
from dateline.schemas import SELECTOR

_BRACKET = re.compile(
    r"\[\s*([A-Za-z_][\w:.-]*)\s*"
    r"(?:([!^$*~]?=)\s*('[^']*'|\"[^\"]*\"|(?:[^\[\]]|\[[^\]]*\])*?)\s*)?\]"
)
_NAME = re.compile(r"[.#]([\w-]+)")
_TAG = re.compile(r"[A-Za-z][\w-]*|\*")
_CHILD = re.compile(r"\s*>\s*")
_GROUP = re.compile(r"\s*,\s*")
_BELOW = re.compile(r"\s+")

Pred = tuple[str, str, str]
Step = tuple[str | None, list[Pred]]
Link = list[Step]


def _bracket(attr: str, op: str | None, value: str | None) -> Pred:
    if op is None:
        return attr.lower(), "has", ""
    quoted = len(value) > 1 and value[0] in "'\"" and value[-1] == value[0]
    value = value[1:-1] if quoted else value
    if op == "~=":
        re.compile(value)  # one that cannot work is refused here, not when pages are read
        return attr.lower(), op, value
    value = value.lower()
    return attr.lower(), op, value if quoted and op in ("^=", "$=") else value.strip()


def parse_selector(selector: str) -> list[list[Link]] | None:
    """Groups of links of steps, from the outermost element inwards; None when unsupported."""
    try:
        return _parsed(selector)
    except re.error:
        return None


def _parsed(selector: str) -> list[list[Link]] | None:
    text, at = selector.strip(), 0
    groups: list[list[Link]] = [[[]]]
    while True:
        start = at
        tag = None
        if found := _TAG.match(text, at):
            tag, at = found.group().lower(), found.end()
        preds: list[Pred] = []
        while found := _BRACKET.match(text, at) or _NAME.match(text, at):
            if text[at] == "[":
                preds.append(_bracket(*found.groups()))
            elif text[at] == ".":
                preds.append(("class", "word", found.group(1).lower()))
            else:
                preds.append(("id", "=", found.group(1).lower()))
            at = found.end()
        if at == start:
            return None
        groups[-1][-1].append((None if tag == "*" else tag, preds))
        if at == len(text):
            return groups
        if found := _GROUP.match(text, at):
            groups.append([[]])
        elif not (found := _CHILD.match(text, at)):
            if not (found := _BELOW.match(text, at)):
                return None
            groups[-1].append([])
        at = found.end()


_PREDS = pa.list_(pa.struct([(name, pa.string()) for name in ("attr", "op", "value")]))
_LINKS = pa.list_(pa.list_(pa.struct([("tag", pa.string()), ("preds", _PREDS)])))


def _link_rows(link: Link) -> list[dict]:
    return [
        {"tag": tag, "preds": [{"attr": a, "op": op, "value": v} for a, op, v in preds]}
        for tag, preds in link
    ]


def _selector_rows(selector: str | None) -> list[list[list[dict]]] | None:
    groups = parse_selector(selector) if selector is not None else None
    return groups and [[_link_rows(link) for link in links] for links in groups]


@F.arrow_udf(T.ArrayType(SELECTOR))
def _compile(selectors: pa.Array) -> pa.Array:
    rows = [
        None if texts is None else [_selector_rows(text) for text in texts]
        for texts in selectors.to_pylist()
    ]
    return pa.array(rows, pa.list_(pa.list_(_LINKS)))


def compiled(selectors: Column) -> Column:
    """An array of selectors to an array of what ``schemas.SELECTOR`` holds; meant for a site table."""
    return _compile(selectors)


@dataclass(frozen=True)
class Css:
    """A literal selector, already parsed."""

    groups: list[list[Link]]


def css(selector: str) -> Css:
    groups = parse_selector(selector)
    if groups is None:
        raise ValueError(f"unsupported selector: {selector!r}")
    return Css(groups)


def _value(element: Column, name: Column | str) -> Column:
    """Value of an attribute, null when absent."""
    return F.get(F.filter(element["attrs"], lambda a: a["k"] == name), 0)["v"]


_TESTS = {
    "has": lambda value, want: value.isNotNull(),
    "=": lambda value, want: java_trim(F.lower(value)) == want,
    "!=": lambda value, want: F.coalesce(java_trim(F.lower(value)) != want, F.lit(True)),
    "^=": lambda value, want: F.startswith(F.lower(value), want),
    "$=": lambda value, want: F.endswith(F.lower(value), want),
    "*=": lambda value, want: F.contains(F.lower(value), want),
    "~=": lambda value, want: F.regexp_like(value, want),
    "word": lambda value, want: F.array_contains(F.split(F.lower(value), r"\s+"), want),
}


def _holds(element: Column, pred: Column) -> Column:
    value = _value(element, pred["attr"])
    result = F.lit(False)
    for op, test in _TESTS.items():
        result = F.when(pred["op"] == op, test(value, pred["value"])).otherwise(result)
    return F.coalesce(result, F.lit(False))


def _fits(element: Column, step: Column | Step) -> Column:
    if isinstance(step, Column):
        tag_fits = F.coalesce(step["tag"].isNull() | (element["tag"] == step["tag"]), F.lit(False))
        return tag_fits & F.forall(step["preds"], lambda p: _holds(element, p))
    tag, preds = step
    result = F.lit(True) if tag is None else F.coalesce(element["tag"] == tag, F.lit(False))
    for attr, op, want in preds:
        test = _TESTS[op](_value(element, attr), F.lit(want))
        result = result & F.coalesce(test, F.lit(False))
    return result


def _top(els: Column, index: Column, link: Column | Link) -> Column:
    """Where a link that ends at this element begins, -2 when it does not hold."""
    if isinstance(link, list):
        element = F.get(els, index)
        result, at, holds = index, element["parent"], _fits(element, link[-1])
        for step in reversed(link[:-1]):
            above = F.get(els, at)
            holds = holds & (at >= 0) & _fits(above, step)
            result, at = at, above["parent"]
        return F.when(holds, result).otherwise(-2)
    before = F.reverse(F.slice(link, 1, F.greatest(F.size(link) - 1, F.lit(0))))
    # Climb from the element towards the root; -2 means a step failed.
    climbed = F.aggregate(
        before,
        index,
        lambda at, step: F.when(
            (at >= 0) & (F.get(els, at)["parent"] >= 0) & _fits(F.get(els, F.get(els, at)["parent"]), step),
            F.get(els, at)["parent"],
        ).otherwise(-2),
    )
    return F.when(_fits(F.get(els, index), F.element_at(link, -1)), climbed).otherwise(-2)


_NONE = "cast(array() as array<int>)"


def _last(els: Column, index: Column) -> Column:
    return F.get(els, index)["last"]


def _outermost(els: Column, found: Column) -> Column:
    """Those of the elements, in document order, that lie below no other of them.

    Beginnings and ends are sorted together; the place of a beginning tells how many
    elements begun before it have ended, so whether one is still open.
    """
    marks = F.array_sort(
        F.concat(
            F.transform(found, lambda e, k: F.struct(e.alias("at"), F.lit(0).alias("end"), k.alias("k"))),
            F.transform(found, lambda e, k: F.struct(_last(els, e).alias("at"), F.lit(1).alias("end"), k.alias("k"))),
        )
    )
    placed = F.transform(marks, lambda m, at: F.struct(m["at"].alias("at"), m["end"].alias("end"), (2 * m["k"] - at).alias("open")))
    return F.transform(F.filter(placed, lambda m: (m["end"] == 0) & (m["open"] == 0)), lambda m: m["at"])


def _first_link(els: Column, link: Column | Link) -> Column:
    everything = F.sequence(F.lit(0), F.size(els) - 1)
    return F.when(F.size(els) > 0, F.filter(everything, lambda i: _top(els, i, link) >= 0)).otherwise(F.expr(_NONE))


def _below(els: Column, found: Column, link: Column | Link) -> Column:
    """Elements at which the link ends, all of it below the elements found before."""

    def within(e: Column) -> Column:
        inside = F.sequence(e + 1, _last(els, e))
        return F.when(_last(els, e) > e, F.filter(inside, lambda i: _top(els, i, link) > e)).otherwise(F.expr(_NONE))

    return F.flatten(F.transform(_outermost(els, found), within))


def _chain(els: Column, links: Column | list[Link]) -> Column:
    """Indexes of the elements one group selects, in document order."""
    if isinstance(links, list):
        found = _first_link(els, links[0])
        for link in links[1:]:
            found = _below(els, found, link)
        return found
    first = _first_link(els, F.get(links, F.lit(0)))
    rest = F.slice(links, 2, F.greatest(F.size(links) - 1, F.lit(0)))
    return F.when(F.size(links) == 1, first).otherwise(
        F.aggregate(rest, first, lambda found, link: _below(els, found, link))
    )


def _union(several: Column) -> Column:
    return F.array_sort(F.array_distinct(F.flatten(several)))


def matched(dom: Column, selector: Column | Css) -> Column:
    """Indexes of the selected elements, in document order."""
    els = dom["els"]
    if isinstance(selector, Css):
        groups = [_chain(els, links) for links in selector.groups]
        return groups[0] if len(groups) == 1 else _union(F.array(*groups))
    only = F.size(selector) == 1
    return F.when(only, _chain(els, F.get(selector, F.lit(0)))).otherwise(
        _union(F.transform(selector, lambda links: _chain(els, links)))
    )


def select_texts(dom: Column, selector: Column | Css) -> Column:
    """Texts of all selected elements."""
    return F.transform(matched(dom, selector), lambda i: element_text(dom, F.get(dom["els"], i)))


def select_text(dom: Column, selector: Column | Css) -> Column:
    """Texts of all selected elements joined by one blank."""
    return F.array_join(F.filter(select_texts(dom, selector), lambda t: t != ""), " ")


def select_first(dom: Column, selector: Column | Css) -> Column:
    """The first selected element, null when nothing is selected."""
    return F.get(dom["els"], F.get(matched(dom, selector), 0))


def select_attr(dom: Column, selector: Column | Css, name: str) -> Column:
    """``(elem_idx, value)`` of an attribute over the selected elements; null if absent."""
    return F.transform(
        matched(dom, selector),
        lambda i: F.struct(
            i.alias("elem_idx"), _value(F.get(dom["els"], i), name).alias("value")
        ),
    )
