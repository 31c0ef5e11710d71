import random
import re
import time
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from dateline.operators.extract import explode_links, parse_articles
from dateline.operators import markup
from dateline.operators.markup import _dom, elements, read_tree, with_dom
from dateline.operators.selectors import compiled, css, matched, parse_selector, select_text

# A page of a seed shop, with one case for every form of selector.
PAGE = """<!doctype html><html><head><title>Peas &amp; beans</title><base href="https://seeds.test/shop/">
<style>nav > a { color: red }</style></head><body id=top>
<nav class="crumbs wide"><span data-level=1><a href="/herbs">Herbs</a></span><span data-level=1><a href=roots.htm>Roots</a></span>
<span data-level="2"><a name=mark>Mark</a></span></nav>
<section class="Card card--tall"><p>Sugar<i> snap<p>Runner &gt; bush<br>bean</i></section>
<dl><dt>Sown<dd title=" March ">early<dt>Picked<dd title="July">late</dl>
<a rel=bulk href="/lot/2024/a.htm">Lot A</a><a rel=bulk href="/lot/2025/b.htm">Lot B</a>
<time datetime="2025-06-03T07:45:00Z">June</time><time datetime="2023">then</time>
<table><tr><th>k<td>v</table></body></html>"""


def outline(html):
    tree = read_tree(html)
    text = "".join(tree.chunks)
    return [(tree.parent[i], tree.tag[i], text[tree.lo[i] : tree.hi[i]].strip()) for i in range(len(tree.tag))]


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("", []),
        (None, []),
        ("plain", []),
        ("<p>a<p>b", [(-1, "p", "a"), (-1, "p", "b")]),
        ("<p><b>a<p>b", [(-1, "p", "a"), (0, "b", "a"), (-1, "p", "b"), (2, "b", "b")]),
        ("<ul><li>a<ul><li>b</ul><li>c</ul>",
         [(-1, "ul", "a b c"), (0, "li", "a b"), (1, "ul", "b"), (2, "li", "b"), (0, "li", "c")]),
        ("<div>a<br>b<!-- x > y --> c</div>", [(-1, "div", "a b c"), (0, "br", "")]),
        ("<p>a  \n b c​d</p>", [(-1, "p", "a b cd")]),
        ("<div><span>a</span><span>b</span><p>c</p>d</div>",
         [(-1, "div", "ab c d"), (0, "span", "a"), (0, "span", "b"), (0, "p", "c")]),
        ("<style>p>a</style><p>x", [(-1, "style", ""), (-1, "p", "x")]),
        ("<script>if (a</script", [(-1, "script", "")]),
        ("<p>a</div>b", [(-1, "p", "ab")]),
        ("<p>1 < 2 & 3 &copy; &am</p>", [(-1, "p", "1 < 2 & 3 © &am")]),
        ("<table><tr><td>a<td>b<tr><td>c</table>",
         [(-1, "table", "a b c"), (0, "tbody", "a b c"), (1, "tr", "a b"), (2, "td", "a"), (2, "td", "b"),
          (1, "tr", "c"), (5, "td", "c")]),
    ],
)
def test_trees(html, want):
    assert outline(html) == want


def test_attributes():
    tree = read_tree("<a HREF='/q?a=1&copy=2&amp;b' title=it's data-x class=\"a b\" class=z>")
    assert tree.attrs[0] == [("href", "/q?a=1&copy=2&b"), ("title", "it's"), ("data-x", ""), ("class", "a b")]


def test_adversarial_markup_is_linear():
    import time

    start = time.perf_counter()
    read_tree('<a "' * 20000 + "<" * 20000 + " " * 50000 + "<!--" * 5000)
    assert time.perf_counter() - start < 5


@pytest.mark.parametrize(
    ("part", "most"),
    [("<p><b>x", 5), ("<div>", 1), ("<p><b><i>x", 9), ("<div><b>x</div>", 5), ("<span></p>", 2), ("<body>", 1)],
)
def test_elements_and_time_follow_the_page(part, most):
    import time

    n = 14_000 if part != "<span></p>" else 3000
    start = time.perf_counter()
    tree = read_tree(part * n)
    assert len(tree.tag) <= most * n + 1
    assert time.perf_counter() - start < 8


def test_formatting_of_many_kinds_is_bounded():
    tree = read_tree("".join(f"<p><b id={k}>x" for k in range(3000)))
    assert len(tree.tag) <= 14 * 3000


SELECTORS = {
    "nav > span[data-level=1] > a[href]": ["Herbs", "Roots"],
    "nav[class=crumbs] > span": [],
    "nav.wide > span[data-level='2'] > a": ["Mark"],
    "section[class='card card--tall'] > p": ["Sugar snap", "Runner > bush bean"],
    "SECTION[CLASS='Card CARD--tall\t'] > P": ["Sugar snap", "Runner > bush bean"],
    "dd[title=march]": ["early"],
    "dd[title!=march]": ["late"],
    "a[href^='/lot/2024']": ["Lot A"],
    "a[href$=htm]": ["Roots", "Lot A", "Lot B"],
    "a[rel=bulk][href~=20[0-9]5]": ["Lot B"],
    "a[href*=ER]": ["Herbs"],
    "#top > time[datetime]": ["June", "then"],
    "section > i": [],
    "dl > a": [],
    "nav a[href]": ["Herbs", "Roots"],
    "body section i": ["snap", "Runner > bush bean"],
    "html   nav > span a": ["Herbs", "Roots", "Mark"],
    "nav > a": [],
    "span span": [],
    "table td": ["v"],
    "body > table tr > td, th": ["k", "v"],
    "time[datetime] , dt,dd[title=march]": ["Sown", "early", "Picked", "June", "then"],
    "a[rel=bulk], #top a[href*=lot], a": ["Herbs", "Roots", "Mark", "Lot A", "Lot B"],
    "p, section p , section > p": ["Sugar snap", "Runner > bush bean"],
    "a[href^='/lot, /x']": [],
}


@pytest.fixture(scope="module")
def page(spark):
    return with_dom(spark.createDataFrame([("https://seeds.test/x/y", PAGE)], "url string, html string")).cache()


@pytest.mark.parametrize("selector", SELECTORS)
def test_selectors_literal_and_as_data(page, selector):
    want = SELECTORS[selector]
    literal = page.select(select_text(F.col("dom"), css(selector))).first()[0]
    assert literal == " ".join(want)
    data = page.withColumn("s", compiled(F.array(F.lit(selector)))[0])
    assert data.select(select_text(F.col("dom"), F.col("s"))).first()[0] == " ".join(want)
    assert data.select(F.size(matched(F.col("dom"), F.col("s")))).first()[0] == len(want)


@pytest.mark.parametrize("selector", ["p:first-child", "", "> a", "a >", "a + b", "[a=", "a[b=c]]", ",a", "a,", "a,,b", "a > > b", "a, > b"])
def test_unsupported_selectors_are_refused(selector):
    assert parse_selector(selector) is None
    with pytest.raises(ValueError, match="unsupported"):
        css(selector)


def plain_matches(tree, selector):
    """Elements by trying every ancestor for every step; steps are a tag and classes."""
    found = set()
    for group in selector.split(","):
        parts = re.findall(r">|[^\s>]+", group)

        def fits(i, part):
            tag, *classes = part.split(".")
            own = dict(tree.attrs[i]).get("class", "").split()
            return tag in ("*", "", tree.tag[i]) and all(c in own for c in classes)

        def holds(i, at):
            if not fits(i, parts[at]):
                return False
            if at == 0:
                return True
            up, child = tree.parent[i], parts[at - 1] == ">"
            while up >= 0:
                if holds(up, at - 2 if child else at - 1):
                    return True
                up = -1 if child else tree.parent[up]
            return False

        found |= {i for i in range(len(tree.tag)) if holds(i, len(parts) - 1)}
    return sorted(found)


def test_chains_and_groups_against_all_ancestors(spark):
    draw = random.Random(8)
    tags = ["div", "span", "section", "article"]

    def markup(depth):
        inner = "".join(markup(depth - 1) for _ in range(draw.randrange(4))) if depth else "x"
        kinds = f' class="{draw.choice("uvw")} {draw.choice("uvw")}"' if draw.random() < 0.5 else ""
        tag = draw.choice(tags)
        return f"<{tag}{kinds}>{inner}</{tag}>"

    def chain():
        steps = [draw.choice([*tags, "*", "div.u", ".v", "span.w"]) for _ in range(draw.randint(1, 4))]
        return steps[0] + "".join(draw.choice([" > ", " ", " "]) + step for step in steps[1:])

    pages = [markup(6) for _ in range(12)] + ["<div>" * 40 + "<span>x", "", "text"]
    selectors = [chain() for _ in range(24)] + [f"{chain()}, {chain()}" for _ in range(8)] + ["div div div > span", "div > div span"]
    table = with_dom(spark.createDataFrame(list(enumerate(pages)), "page int, html string"))
    literal = F.array(*[matched(F.col("dom"), css(x)) for x in selectors])
    rows = table.select("page", literal.alias("literal"), "dom", compiled(F.array(*map(F.lit, selectors))).alias("data"))
    data = F.transform("data", lambda s: matched(F.col("dom"), s))
    found = 0
    for row in rows.select("page", "literal", data.alias("data")).collect():
        want = [plain_matches(read_tree(pages[row["page"]]), x) for x in selectors]
        assert row["literal"] == want
        assert row["data"] == want
        found += sum(map(len, want))
    assert found > 500


def test_descent_on_large_pages_is_linear(spark):
    pages = ["<div>" * 4000 + "<span>x", "<div><span>x</span></div>" * 20_000]
    table = with_dom(spark.createDataFrame(list(enumerate(pages)), "page int, html string")).cache()
    table.count()
    start = time.perf_counter()
    sizes = table.select("page", F.size(matched(F.col("dom"), css("div span"))).alias("n")).collect()
    assert sorted(map(tuple, sizes)) == [(0, 1), (1, 20_000)]
    assert time.perf_counter() - start < 20


def test_links_follow_the_base_element(page):
    rows = explode_links(page, [css("span > a[href]"), css("a")], "topic").collect()
    assert [(r["selector_idx"], r["dst"].removeprefix("https://seeds.test/")) for r in rows] == [
        (0, "herbs"), (0, "shop/roots.htm"),
        (1, "herbs"), (1, "shop/roots.htm"), (1, "lot/2024/a.htm"), (1, "lot/2025/b.htm"),
    ]


def test_article(page):
    row = parse_articles(
        page, F.lit("seeds.test"), F.lit("2026-01-02 03:04:05").cast("timestamp"),
        title=css("title"), body=css("section > p"), time=css("time[datetime]"),
    ).first()
    assert row["title"] == "Peas & beans"
    assert row["body"] == "Sugar snap Runner > bush bean"
    assert (row["publishTime"], row["crawledAt"]) == ("2025-06-03 07:45:00", "2026-01-02 03:04:05")
    assert row.__fields__ == ["id", "url", "title", "body", "source", "publishTime", "crawledAt"]


def test_pages_are_parsed_once(spark, page):
    pages = with_dom(spark.createDataFrame([("https://seeds.test/a", PAGE)] * 3, "url string, html string"))
    for frame in (explode_links(pages, [css("a[href]")], "topic"), elements(pages, "url")):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert plan.count("ArrowEvalPython") == 1
    rows = elements(pages, "url").where("tag in ('th', 'td')").select("text").collect()
    assert [r["text"] for r in rows] == ["k", "v"] * 3


def test_trees_of_a_batch_are_not_held_together():
    """A batch four times as long needs as many Python objects at a time, and gives the same trees."""
    pages = [PAGE.replace("Peas", f"Peas {i}") for i in range(600)] + [None, ""]

    def peak(count):
        batch = pa.array(pages * count, pa.string())
        tracemalloc.start()
        found = _dom.func(batch)
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return most, found

    (one, few), (four, many) = peak(1), peak(4)
    assert four < 1.3 * one
    assert len(many) == 4 * len(pages) and many[len(pages) : 2 * len(pages)].equals(few)
    assert few[:1].equals(_dom.func(pa.array(pages[:1]))) and few[-2].as_py() == {"text": "", "els": []}


def test_trees_go_back_piece_by_piece(monkeypatch):
    """A batch four times as long holds no more Arrow memory, and gives the same trees."""
    monkeypatch.setattr(markup, "HELD", 1 << 14)

    def batch(count):
        return pa.array([PAGE.replace("Peas", f"Peas {i}") for i in range(count)] + [None, ""], pa.string())

    def most(html):
        before = pa.total_allocated_bytes()
        return max(pa.total_allocated_bytes() - before for _ in markup._streamed.func(iter([html])))

    assert most(batch(800)) < 1.5 * most(batch(200))
    several = [batch(100), batch(0), batch(100)[:0], batch(7)]
    found = pa.concat_arrays(list(markup._streamed.func(iter(several))))
    assert found.equals(_dom.func(pa.concat_arrays(several)))


def test_pieces_keep_to_their_pages(spark):
    """Batches of one task that go back in several pieces each, next to columns that stay in the JVM."""
    html = F.replace(F.lit(PAGE), F.lit("Peas"), F.concat(F.lit("Peas "), F.col("id").cast("string")))
    pages = spark.range(0, 24000, 1, 1).where("id % 7 <> 3").select("id", html.alias("html"))
    named = F.col("dom.text").startswith(F.concat(F.lit("Peas "), F.col("id").cast("string"), F.lit(" ")))
    found = with_dom(pages).agg(F.count("*"), F.count_if(named)).first()
    assert found[0] == found[1] == pages.count()
