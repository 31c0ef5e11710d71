import pytest
from pyspark.sql import functions as F

from dateline.operators import crawl as walks
from dateline.operators.crawl import crawl, frontier
from dateline.operators.ranking import first_per_group
from dateline.schemas import SITE_CONFIG
from dateline.session import cut
from dateline.sources.configs import rejected_sites, site_table
from dateline.sources.robots import allowed, robots_rules

ROBOTS = [
    ("a.com", "User-agent: *\nDisallow: /x\n\nUser-Agent: foo\nUser-agent: testbot\nDisallow: /private # c\n"
              "Allow: /private/ok\r\nDisallow: /*.pdf$\nCrawl-delay: 3\n\nuser-agent: TestBot/2\nDisallow: /q?s=\n"),
    ("b.com", ""),
    ("c.com", None),
    ("d.com", "user-agent:*\ndisallow: /\nallow: /\n"),
    ("e.com", "User-agent: *\nDisallow:\n"),
    ("f.com", "Disallow: /early\nUser-agent: other\nDisallow: /\n"),
]


@pytest.fixture(scope="module")
def rules(spark):
    return robots_rules(spark.createDataFrame(ROBOTS, "host string, txt string"), "TestBot/1.0 (x)").cache()


@pytest.mark.parametrize(
    ("host", "url", "want"),
    [
        ("a.com", "https://a.com/private/z", False),
        ("a.com", "https://a.com/private/ok/1", True),
        ("a.com", "https://other.org/private/z", False),
        ("a.com", "https://a.com/x", True),
        ("a.com", "https://a.com/q/f.pdf", False),
        ("a.com", "https://a.com/q/f.pdf?x", True),
        ("a.com", "https://a.com/q?s=1", False),
        ("a.com", "https://a.com/Private/z", True),
        ("a.com", "https://a.com", True),
        ("b.com", "https://b.com/any", True),
        ("d.com", "https://d.com/any", True),
        ("e.com", "https://e.com/any", True),
        ("f.com", "https://f.com/early", True),
        ("d.com", "https://d.com/robots.txt", True),
    ],
)
def test_robots(rules, host, url, want):
    row = rules.where(F.col("host") == host).select(allowed(F.lit(url), F.col("rules"))).first()
    assert row[0] is want


def test_host_without_robots_forbids(spark, rules):
    assert rules.where("host = 'c.com'").count() == 0
    row = spark.range(1).select(allowed(F.lit("https://c.com/"), F.lit(None).cast("array<struct<allow:boolean,pattern:string,wild:boolean,regex:string>>")))
    assert row.first()[0] is False


PAGES = [
    ("https://a.com", '<a class=t href="/t1">1</a><a class=t href="/t2">2</a><a class=t href="//b.com/o">o</a>'
                      '<a class=t href="/gone">g</a><a class=s href="/n/1">x</a><a class=s href="/n/1">again</a>'),
    ("https://a.com/t1", '<a class=s href="/n/2">x</a><a class=s href="/n/1">x</a><a class=s href="/n/404">x</a>'
                         '<a class=t href="/t2">2</a><a class=t href="https://a.com">up</a>'),
    ("https://a.com/t2", '<a class=t href="t3/../t3">3</a><a class=s href="/private/1">x</a>'),
    ("https://a.com/t3", '<a class=s href="https://b.com/n/9">x</a><a class=t href="/t4">4</a>'),
    ("https://a.com/t4", '<a class=s href="/n/4">x</a>'),
    ("https://b.com/o", '<a class=s href="/n/8">x</a>'),
    ("https://b.com/n/8", "<h1>B8</h1><p>text  b</p>"),
    ("https://b.com/n/9", "<h1>B9</h1><p>text  b</p>"),
    ("https://a.com/n/1", '<h1>A1</h1><time datetime="2025-11-14T05:30:00+01:00">z</time><p>one<p>two &amp; three'),
    ("https://a.com/n/2", "<h1>A2</h1><time>Updated 14 Nov 2025</time><p>one"),
    ("https://a.com/n/4", "<h1>A4</h1>"),
    ("https://a.com/private/1", "<h1>P</h1>"),
]
CONFIGS = [
    ("https://a.com", ["a[class='t']"], ["a.s[href]"], "h1", "time", "p", 2),
    ("https://c.com", ["a"], ["a"], "h1", "time", "p", 3),
    ("https://e.com", ["a:hover"], ["a"], "h1", "time", "p", 3),
]


@pytest.fixture(scope="module")
def sites(spark, rules):
    return site_table(spark.createDataFrame(CONFIGS, SITE_CONFIG), rules)


def run(spark, sites, cap):
    pages = spark.createDataFrame(PAGES, "url string, html string")
    return crawl(pages, sites, F.lit("2026-01-02 03:04:05").cast("timestamp"), cap)


def test_crawl(spark, sites):
    result = run(spark, sites, 100)
    rows = result.articles.orderBy("rank").collect()
    assert [(r["url"], r["title"], r["body"], r["source"], r["publishTime"]) for r in rows] == [
        ("https://a.com/n/1", "A1", "one two & three", "a.com", "2025-11-14 04:30:00"),
        ("https://a.com/n/2", "A2", "one", "a.com", "2025-11-14 00:00:00"),
        ("https://b.com/n/8", "B8", "text b", "a.com", "2026-01-02 03:04:05"),
        ("https://b.com/n/9", "B9", "text b", "a.com", "2026-01-02 03:04:05"),
    ]
    visited = {(r["url"], r["depth"]) for r in result.visited.where("kind = 'topic'").collect()}
    assert visited == {
        ("https://a.com", 0), ("https://a.com/t1", 1), ("https://a.com/t2", 1), ("https://b.com/o", 1),
        ("https://a.com/gone", 1), ("https://a.com/t3", 2),
    }
    failed = {r["url"] for r in result.failed.collect()}
    assert failed == {"https://a.com/gone", "https://a.com/n/404"}


@pytest.mark.parametrize("cap", [0, 1, 2])
def test_crawl_cap(spark, sites, cap):
    urls = [r["url"] for r in run(spark, sites, cap).articles.orderBy("rank").collect()]
    assert urls == ["https://a.com/n/1", "https://a.com/n/2"][:cap]


def test_sites_without_robots_or_with_bad_selectors_drop_out(sites):
    assert [r["site"] for r in sites.select("site").collect()] == ["https://a.com"]


def depth_first(edges, root, limit):
    seen = set()

    def walk(node, depth):
        if depth > limit or node in seen:
            return
        seen.add(node)
        for following in edges.get(node, []):
            walk(following, depth + 1)

    walk(root, 0)
    return seen


def test_frontier_contains_the_depth_first_walk(spark):
    edges = {"r": ["a", "b"], "a": ["b", "r"], "b": ["c"], "c": ["d"], "x": ["r"]}
    links = spark.createDataFrame([("s", a, b) for a, bs in edges.items() for b in bs], "site string, src string, dst string")
    roots = spark.createDataFrame([("s", "r")], "site string, url string")
    got = {r["url"]: r["depth"] for r in frontier(links, roots, 2).collect()}
    assert got == {"r": 0, "a": 1, "b": 1, "c": 2}
    assert depth_first(edges, "r", 2) < set(got)


@pytest.mark.parametrize("n", [0, 3, 1500])
def test_first_per_group_with_a_hot_group(spark, n):
    rows = spark.range(6000).select(F.when(F.col("id") % 3 < 2, "hot").otherwise(F.col("id").cast("string")).alias("g"), "id")
    got = first_per_group(rows, ["g"], [F.col("id").desc()], n, rank="rank")
    hot = [r["id"] for r in got.where("g = 'hot'").orderBy("rank").collect()]
    assert hot == [i for i in range(5999, -1, -1) if i % 3 < 2][:n]
    assert got.where("g <> 'hot'").count() == (2000 if n else 0)


def test_repeated_pages_and_markup_that_is_not_shuffled(spark, rules):
    rows = [
        ("https://a.com", '<a class=t href="/t">t</a><a class=s href="/n/1">1</a><a class=s href="/n/2">2</a>'),
        ("https://a.com", '<a class=t href="/t">t</a><a class=s href="/n/1">1</a><a class=s href="/n/2">2</a><i>later</i>'),
        ("https://a.com/n/1", "<h1>One</h1><p>body</p>"), ("https://a.com/n/1", "<h1>One again</h1><p>body</p>"),
        ("https://a.com/n/2", "<h1>Two</h1><p>body</p>"), ("https://a.com/t", "<p>x"),
    ]
    pages = spark.createDataFrame(rows, "url string, html string")
    config = [("https://a.com", 2, [".t"], [".s"], "h1", "time", "p")]
    names = {"baseUrl": 0, "maxDepth": 1, "topicSelectors": 2, "articleSelectors": 3, "articleTitle": 4, "articleTime": 5, "articleBody": 6}
    sites = site_table(spark.createDataFrame([tuple(config[0][names[f]] for f in SITE_CONFIG.fieldNames())], SITE_CONFIG), rules)
    result = crawl(pages, sites, F.lit("2026-01-02").cast("timestamp"), 1)
    assert [(r["rank"], r["url"]) for r in result.articles.collect()] == [(1, "https://a.com/n/1")]
    whole = crawl(pages, sites, F.lit("2026-01-02").cast("timestamp"), 10)
    plan = whole.articles._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    assert not any("Exchange" in line and "html" in line for line in plan.splitlines())
    assert sorted(r["url"] for r in whole.articles.collect()) == ["https://a.com/n/1", "https://a.com/n/2"]


def test_unusable_sites_are_reported(spark, rules):
    base = {"maxDepth": 1, "topicSelectors": ["a"], "articleSelectors": ["a"], "articleTitle": "h1", "articleTime": "time", "articleBody": "p"}
    rows = [
        {**base, "baseUrl": "https://a.com"},
        {**base, "baseUrl": "https://b.com", "topicSelectors": ["a[href~=(]"]},
        {**base, "baseUrl": "https://unknown.com"},
    ]
    configs = spark.createDataFrame([tuple(r[f] for f in SITE_CONFIG.fieldNames()) for r in rows], SITE_CONFIG)
    assert [r["site"] for r in site_table(configs, rules).collect()] == ["https://a.com"]
    got = {(r["site"], r["reason"]) for r in rejected_sites(configs, rules).collect()}
    assert got == {("https://b.com", "selector"), ("https://unknown.com", "robots")}


def test_sites_of_a_host_share_what_is_read(spark, monkeypatch):
    n = 30
    urls = [f"https://a.com/{i}" for i in range(n)]
    pages = spark.createDataFrame(
        [(url, f'<h1>{i}</h1><a class=t href="/{(i + 1) % n}">t</a><a class=s href="/{(i + 2) % n}">s</a><b href="/0">b</b>')
         for i, url in enumerate(urls)],
        "url string, html string",
    )
    # The last two sites differ, one in its links and one in its rules; the first is configured twice.
    rules = robots_rules(spark.createDataFrame([("a.com", "User-agent: *\nDisallow: /0\n")], "host string, txt string"), "x")
    configs = [(url, ["a.t"], ["b[href]" if i == n - 2 else "a.s"], "h1", "time", "p", 1) for i, url in enumerate([*urls, urls[0]])]
    named = site_table(spark.createDataFrame(configs, SITE_CONFIG), rules)
    free = F.expr("filter(rules, r -> r.allow)")
    sites = named.withColumn("rules", F.when(F.col("site") == urls[n - 1], free).otherwise(F.col("rules")))

    tables = []

    def counted(df, name="cut"):
        table = cut(df, name)
        tables.append((name, table.count()))
        return table

    monkeypatch.setattr(walks, "cut", counted)
    result = crawl(pages, sites, F.lit("2026-01-02").cast("timestamp"), 5)
    got = {}
    for row in result.articles.orderBy("rank").collect():
        got.setdefault(row["site"], []).append((row["url"], row["title"], row["source"]))
    # No table holds the pages of the host once for each of its sites.
    assert max(count for _, count in tables) <= 2 * n + 2, tables

    def reached(i):
        """Site i reads pages i and i + 1, each naming the article two pages on; /0 is forbidden, but to the last site."""
        article = lambda k: (urls[k % n], str(k % n), "a.com")
        if i == n - 2:
            return []
        if i == n - 1:
            return [article(i + 2), article(i + 3)]
        return [article(k) for k in (i + 2, i + 3) if k % n and (k == i + 2 or (i + 1) % n)]

    want = {urls[i]: reached(i) for i in range(1, n)}
    assert got == {site: articles for site, articles in want.items() if articles}
