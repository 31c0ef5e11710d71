"""Links and article records out of page trees; map-only.

Columns are staged: an expression used more than once is a column of its own, so it is
computed once per page. A ``Stages`` list is built once and applied to any page table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dateline.functions.text import article_id, time_text
from dateline.functions.times import Stages, apply, time_attribute, time_stages
from dateline.functions.urls import absolute_url, base_parts
from dateline.operators.markup import element_text
from dateline.operators.selectors import Css, css, select_attr, select_first, select_text

def base_stages() -> Stages:
    """``base``: what links are relative to, the first ``base`` element or the URL."""
    declared = F.get(select_attr(F.col("dom"), css("base[href]"), "href"), 0)["value"]
    given = "_declared is null or _declared = ''"
    return [
        {"_own": F.expr(base_parts("url")), "_declared": declared},
        {"_declared": F.expr(absolute_url("_own", "_declared"))},
        {"base": F.expr(f"if({given}, _own, {base_parts('_declared')})")},
    ]


def link_stages(**selectors: Column | list[Css]) -> Stages:
    """A column per keyword with ``(selector_idx, elem_idx, dst)`` of its links that
    can be resolved, in page order."""

    def hits(steps: Column | Css, position: Column) -> Column:
        return F.transform(
            select_attr(F.col("dom"), steps, "href"),
            lambda hit: F.struct(
                position.cast("int").alias("selector_idx"), hit["elem_idx"], hit["value"]
            ),
        )

    found = {}
    for name, several in selectors.items():
        if isinstance(several, Column):
            lists = F.transform(several, hits)
        else:
            lists = F.array(*[hits(steps, F.lit(i)) for i, steps in enumerate(several)])
        found[name] = F.flatten(lists)
    resolved = {
        name: F.expr(
            f"filter(transform({name}, h -> named_struct('selector_idx', h.selector_idx, "
            f"'elem_idx', h.elem_idx, 'dst', {absolute_url('base', 'h.value')})), h -> h.dst <> '')"
        )
        for name in found
    }
    return [found, resolved]


def with_links(pages: DataFrame, **selectors: Column | list[Css]) -> DataFrame:
    """Add a column of links per keyword to pages with ``url`` and ``dom``."""
    linked = apply(pages, base_stages() + link_stages(**selectors))
    return linked.drop("_own", "_declared")


def explode_links(
    pages: DataFrame, selectors: Column | list[Css], kind: str, *keys: str
) -> DataFrame:
    """One row per link of pages with ``url`` and ``dom``.

    The outer form keeps Spark from testing the list for emptiness below the parser,
    which would parse every page twice.
    """
    rows = with_links(pages, found=selectors).select(
        *keys, F.col("url").alias("src"), F.lit(kind).alias("kind"), F.inline_outer("found")
    )
    return rows.where("dst is not null")


def field_stages(title: Column | Css, body: Column | Css, time: Column | Css | None) -> Stages:
    """``page_title``, ``page_body`` and ``page_time`` (raw, empty when absent)."""
    dom, first = F.col("dom"), F.col("_first")
    texts = {"page_title": select_text(dom, title), "page_body": select_text(dom, body)}
    if time is None:
        return [{**texts, "page_time": F.lit("")}]
    found = time_attribute(first["attrs"], element_text(dom, first))
    return [
        {**texts, "_first": select_first(dom, time)},
        {"page_time": F.when(first.isNull(), F.lit("")).otherwise(found)},
    ]


def article_stages(source: Column, run_ts: Column) -> Stages:
    """``article``: the seven stored fields, from ``field_stages`` columns."""
    record = F.struct(
        article_id(F.col("url")).alias("id"),
        F.col("url").alias("url"),
        F.col("page_title").alias("title"),
        F.col("page_body").alias("body"),
        source.alias("source"),
        time_text(F.col("page_at")).alias("publishTime"),
        time_text(run_ts).alias("crawledAt"),
    )
    return [*time_stages("page_time", run_ts, "page_at"), {"article": record}]


def parse_articles(
    pages: DataFrame,
    source: Column,
    run_ts: Column,
    *,
    title: Column | Css,
    body: Column | Css,
    time: Column | Css | None = None,
) -> DataFrame:
    """Article rows of pages with ``url`` and ``dom``."""
    stages = field_stages(title, body, time) + article_stages(source, run_ts)
    return apply(pages, stages).select("article.*")
