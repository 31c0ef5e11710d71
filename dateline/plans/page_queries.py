"""Pages: extraction, links, robots, crawl."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dateline.functions.text import domain_label, host_of, robots_url
from dateline.operators import crawl as walks
from dateline.operators.extract import explode_links, parse_articles, with_links
from dateline.operators.markup import elements, with_dom
from dateline.operators.ranking import first_per_group
from dateline.operators.selectors import compiled, css, matched
from dateline.plans import inputs
from dateline.session import broadcast_within, cut, scratch_path, spread
from dateline.sources.configs import read_site_configs, site_table
from dateline.sources.pages import failed
from dateline.sources.robots import allowed, robots_rules

TOPICS = "nav > ul > li > a[href]"
FORMS = {
    "tag": "li",
    "has": "meta[charset]",
    "equals": "div[class='ad']",
    "prefix": "a[href^='/t']",
    "contains": "a[href*=th]",
    "regex": "a[href~=^/[A-Z]]",
    "several": "a[href^='/t'][href*='e']",
    "chain": "html > body > article > p",
    "links": TOPICS,
    "class": "div.ad",
    "descendant": "article b",
    "group": "h1, li",
    "mixed": "body nav > ul li a[href]",
    "overlap": "p, article > p, nav a",
}


def page_articles(spark: SparkSession, folder: str) -> DataFrame:
    rows = parse_articles(
        with_dom(inputs.pages(spark, folder)),
        host_of(F.col("url")),
        inputs.run_ts(),
        title=css("h1"),
        body=css("article > p"),
        time=css("time[datetime]"),
    )
    return rows.withColumn("domain", domain_label(F.col("source")))


def headlines_per_host(spark: SparkSession, folder: str) -> DataFrame:
    """The first five articles of every host by URL."""
    rows = page_articles(spark, folder).select("id", "url", "title", "source", "domain")
    unique = first_per_group(rows, ["id"], [F.col("url")])
    return first_per_group(unique, ["source"], [F.col("url")], 5, rank="rank")


def page_links(spark: SparkSession, folder: str) -> DataFrame:
    linked = with_links(
        with_dom(inputs.pages(spark, folder)),
        topic=[css(TOPICS)],
        article=[css(FORMS["prefix"]), css(FORMS["regex"])],
    )

    def tagged(kind: str) -> Column:
        return F.transform(
            kind,
            lambda link, i: F.struct(
                F.lit(kind).alias("kind"), i.alias("pos"), link["selector_idx"], link["dst"]
            ),
        )

    both = F.concat(tagged("topic"), tagged("article"))
    return linked.select("page_id", F.inline(both))


def _sites(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    pages = inputs.pages(spark, folder)
    urls = inputs.table(spark, folder, "pages")
    rules = robots_rules(inputs.robots_texts(urls), inputs.AGENT)
    return pages, cut(site_table(inputs.site_configs(urls), rules), "sites")


def links_per_host(spark: SparkSession, folder: str) -> DataFrame:
    pages, sites = _sites(spark, folder)
    keyed = walks.pages_of_sites(pages, sites)
    links = explode_links(keyed, F.col("links"), "article", "host")
    return links.groupBy("host").agg(F.count("*").alias("n_links"), F.min("dst").alias("first_dst"))


def site_article_cap(spark: SparkSession, folder: str) -> DataFrame:
    links = explode_links(with_dom(inputs.pages(spark, folder)), [css(TOPICS)], "topic")
    keyed = links.withColumn("site", host_of(F.col("src")))
    order = [F.col("src"), F.col("selector_idx"), F.col("elem_idx")]
    first = first_per_group(keyed, ["site", "dst"], order)
    return first_per_group(first, ["site"], [*order, F.col("dst")], 5, rank="rank").select(
        "site", "rank", "src", "dst"
    )


def selector_match(spark: SparkSession, folder: str) -> DataFrame:
    """How many elements each form selects, as a literal and as data joined in by host."""
    pages = inputs.pages(spark, folder).withColumn("host", host_of(F.col("url")))
    texts = F.array(*[F.lit(text) for text in FORMS.values()])
    by_host = cut(inputs.hosts(pages).select("host", compiled(texts).alias("selectors")), "selectors")
    size = F.lit(256 * len(FORMS))
    keyed = with_dom(pages.join(broadcast_within(by_host, size), "host"))
    dom = F.col("dom")
    counts = F.array(
        *[
            F.struct(
                F.lit(form).alias("form"),
                F.size(matched(dom, css(text))).cast("long").alias("n"),
                F.size(matched(dom, F.get("selectors", F.lit(k)))).cast("long").alias("n_data"),
            )
            for k, (form, text) in enumerate(FORMS.items())
        ]
    )
    return keyed.select("page_id", F.inline(counts))


def element_counts(spark: SparkSession, folder: str) -> DataFrame:
    rows = elements(with_dom(inputs.pages(spark, folder)), "page_id")
    return rows.groupBy("page_id", "tag").agg(
        F.count("*").alias("n"), F.count_if(F.size("attrs") > 0).alias("n_attrs")
    )


def robots_allowed(spark: SparkSession, folder: str) -> DataFrame:
    pages = inputs.pages(spark, folder)
    rules = robots_rules(inputs.robots_texts(inputs.table(spark, folder, "pages")), inputs.AGENT)
    links = explode_links(with_dom(pages), [css(TOPICS)], "topic", "page_id")
    hosted = links.withColumn("host", host_of(F.col("src")))
    return hosted.join(rules, "host", "left").select(
        "page_id", "dst", allowed(F.col("dst"), F.col("rules")).alias("ok")
    )


def host_domain(spark: SparkSession, folder: str) -> DataFrame:
    host = host_of(F.col("url"))
    return inputs.table(spark, folder, "pages").select(
        "page_id", host.alias("host"), domain_label(host).alias("domain"), robots_url(host).alias("robots")
    )


def crawl_frontier(spark: SparkSession, folder: str) -> DataFrame:
    ids = inputs.table(spark, folder, "pages").select("page_id")
    total = ids.count()
    key = F.col("page_id")
    sites = F.array(F.lit("a"), F.lit("b"))
    targets = F.array((key * 7 + 1) % total, (key * 3 + 2) % total)
    links = ids.select(F.explode(sites).alias("site"), key.cast("string").alias("src"), targets.alias("t")).select(
        "site", "src", F.explode(F.col("t").cast("array<string>")).alias("dst")
    )
    roots = ids.where((key % 10).isin(0, 5)).select(
        F.when(key % 10 == 0, "a").otherwise("b").alias("site"), key.cast("string").alias("url")
    )
    return walks.frontier(links, roots, 3)


def _linked_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Pages with links to each other put in front of their own: even pages are
    topics, odd ones articles."""
    pages = inputs.table(spark, folder, "pages")
    half = pages.count() // 2
    key = F.col("page_id")
    targets = {
        "t": [2 * ((key * 7 + 1) % half), 2 * ((key * 5 + 3) % half)],
        "s": [2 * ((key * 3 + 2) % half) + 1, 2 * ((key * 11 + 5) % half) + 1],
    }
    links = F.array(
        *[
            F.struct(F.lit(kind).alias("kind"), F.lit(i).alias("i"), target.alias("target"))
            for kind, several in targets.items()
            for i, target in enumerate(several)
        ]
    )
    named = (
        pages.select(key, F.inline(links))
        .join(pages.select(F.col("page_id").alias("target"), "url"), "target")
        .select(key, "kind", "i", F.format_string("<a class=\"%s\" href=\"%s\">x</a>", "kind", "url").alias("a"))
    )
    # Four links per page, so the lists are bounded.
    menus = named.groupBy("page_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("kind", "i", "a"))), lambda x: x["a"]), "").alias("menu")
    )
    return pages.join(menus, "page_id").select(
        "page_id", "url", F.replace("html", F.lit("<nav>"), F.concat(F.lit("<nav>"), "menu")).alias("html")
    )


def site_crawl(spark: SparkSession, folder: str) -> DataFrame:
    pages = cut(_linked_pages(spark, folder), "linked-pages")
    roots = pages.where("page_id % 20 = 0").select("url")
    configs = roots.select(
        F.col("url").alias("baseUrl"),
        F.array(F.lit("nav > a.t")).alias("topicSelectors"),
        F.array(F.lit("a[class='s'][href]")).alias("articleSelectors"),
        F.lit("h1").alias("articleTitle"),
        F.lit("time[datetime]").alias("articleTime"),
        F.lit("article > p").alias("articleBody"),
        F.lit(3).alias("maxDepth"),
    )
    robots = inputs.hosts(pages).select(
        "host",
        F.when(~F.col("host").endswith(".org"), "User-agent: *\nDisallow: /de/\n").alias("txt"),
    )
    sites = site_table(configs, robots_rules(robots, inputs.AGENT))
    found = walks.crawl(spread(pages.select("url", "html")), sites, inputs.run_ts(), 7)
    return found.articles.select("site", "rank", "id", "url", "title", "source", "publishTime")


def failed_fetches(spark: SparkSession, folder: str) -> DataFrame:
    pages = inputs.pages(spark, folder)
    links = explode_links(with_dom(pages), [css(TOPICS)], "topic").select(F.col("dst").alias("url")).distinct()
    wanted = links.unionByName(pages.select("url"))
    return failed(wanted, pages)


def site_configs(spark: SparkSession, folder: str) -> DataFrame:
    """Configurations written as one JSON file per site, read back from the folder."""
    path = scratch_path(spark, "configs")
    configs = inputs.site_configs(inputs.table(spark, folder, "pages"))
    configs.write.option("maxRecordsPerFile", 1).json(path)
    read = read_site_configs(spark, path)
    return read.select(
        "baseUrl",
        F.col("articleSelectors")[0].alias("selector"),
        F.size("topicSelectors").alias("n_topics"),
        "articleTitle",
        "maxDepth",
    )


QUERIES = {
    "page_articles": page_articles,
    "headlines_per_host": headlines_per_host,
    "page_links": page_links,
    "links_per_host": links_per_host,
    "site_article_cap": site_article_cap,
    "selector_match": selector_match,
    "element_counts": element_counts,
    "robots_allowed": robots_allowed,
    "host_domain": host_domain,
    "crawl_frontier": crawl_frontier,
    "site_crawl": site_crawl,
    "failed_fetches": failed_fetches,
    "site_configs": site_configs,
}

_HOST = "regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)"
_ORIGIN = "regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1)"


def _plain(html: str) -> str:
    """SQL for the text of a piece of markup."""
    text = f"regexp_replace({html}, '<[^>]*>', ' ', 'g')"
    for ref, char in (("&quot;?", '"'), ("&lt;?", "<"), ("&gt;?", ">"), ("&amp;?", "&")):
        text = f"regexp_replace({text}, '{ref}', '{char}', 'g')"
    return f"trim(regexp_replace({text}, '[ \\t\\n\\r\\f]+', ' ', 'g'))"


_TITLE = _plain("regexp_extract(html, '<h1>(.*?)</h1>', 1, 's')")
_BODY = _plain("regexp_extract(html, '<article><h1>.*?</h1>(.*)</article>', 1, 's')")
_HREFS = "list_transform(regexp_extract_all(html, '<a href=\"([^\"]*)\">', 1), lambda h: replace(h, '&amp;', '&'))"
_LINKS = f"""
links AS (
  SELECT page_id, url, {_HOST} AS host, unnest(range(len(hrefs)))::INTEGER AS pos, {_ORIGIN} || unnest(hrefs) AS dst,
         unnest(hrefs) AS href
  FROM (SELECT page_id, url, {_HREFS} AS hrefs FROM pages))"""


def _count(pattern: str) -> str:
    return f"len(regexp_extract_all(html, '{pattern}'))"


# An unclosed b goes on in every later block that holds text, three of them at most: of a
# paragraph's elements the b opened before it, and its own.
_OPENED = "regexp_extract_all(html, '<p>|<b>')"
_ALL_B = "len(list_filter(marks, lambda m: m = '<b>'))"
_ARTICLE_B = """coalesce(list_sum(list_transform(marks, lambda m, i: CASE WHEN m = '<b>' THEN 1
    ELSE least(len(list_filter(marks[1:i - 1], lambda x: x = '<b>')), 3) END)), 0)::BIGINT"""


SQL = {
    "page_articles": f"""
SELECT sha256(url) AS id, url, {_TITLE} AS title, {_BODY} AS body, {_HOST} AS source,
       '{inputs.RUN_TIME}' AS "publishTime", '{inputs.RUN_TIME}' AS "crawledAt",
       string_split({_HOST}, '.')[-2] AS domain
FROM pages""",
    "headlines_per_host": f"""
SELECT * FROM (
  SELECT sha256(url) AS id, url, {_TITLE} AS title, {_HOST} AS source,
         string_split({_HOST}, '.')[-2] AS domain,
         row_number() OVER (PARTITION BY {_HOST} ORDER BY url)::INTEGER AS rank
  FROM pages) WHERE rank <= 5""",
    "page_links": f"""
WITH {_LINKS}
SELECT page_id, 'topic' AS kind, pos, 0 AS selector_idx, dst FROM links
UNION ALL
SELECT page_id, 'article', row_number() OVER (PARTITION BY page_id ORDER BY s, pos)::INTEGER - 1, s, dst FROM (
  SELECT *, 0 AS s FROM links WHERE lower(href) LIKE '/t%'
  UNION ALL SELECT *, 1 FROM links WHERE regexp_matches(href, '^/[A-Z]'))""",
    "links_per_host": f"""
WITH {_LINKS}
SELECT host, count(*) AS n_links, min(dst) AS first_dst FROM links
WHERE host NOT LIKE '%.org' AND CASE
  WHEN host LIKE 'm.%' THEN lower(href) LIKE '/t%'
  WHEN host LIKE 'www.%' THEN lower(href) LIKE '%th%'
  WHEN host LIKE 'blog.%' THEN regexp_matches(href, '^/[A-Z]')
  ELSE true END
GROUP BY host""",
    "site_article_cap": f"""
WITH {_LINKS},
firsts AS (
  SELECT *, row_number() OVER (PARTITION BY host, dst ORDER BY url, pos) AS k FROM links)
SELECT * FROM (
  SELECT host AS site, row_number() OVER (PARTITION BY host ORDER BY url, pos, dst)::INTEGER AS rank, url AS src, dst
  FROM firsts WHERE k = 1) WHERE rank <= 5""",
    "selector_match": f"""
WITH marked AS (SELECT page_id, html, {_OPENED} AS marks FROM pages),
counted AS (
SELECT page_id, unnest([
  {{'form': 'tag', 'n': {_count('<li>')}}},
  {{'form': 'has', 'n': {_count('<meta charset=')}}},
  {{'form': 'equals', 'n': {_count('<div class="ad">')}}},
  {{'form': 'prefix', 'n': {_count('<a href="/[tT]')}}},
  {{'form': 'contains', 'n': {_count('<a href="[^"]*[tT][hH]')}}},
  {{'form': 'regex', 'n': {_count('<a href="/[A-Z]')}}},
  {{'form': 'several', 'n': {_count('<a href="/[tT][^"]*[eE]')}}},
  {{'form': 'chain', 'n': {_count('<p>')}}},
  {{'form': 'links', 'n': {_count('<a href="')}}},
  {{'form': 'class', 'n': {_count('<div class="ad">')}}},
  {{'form': 'descendant', 'n': {_ARTICLE_B}}},
  {{'form': 'group', 'n': {_count('<h1>')} + {_count('<li>')}}},
  {{'form': 'mixed', 'n': {_count('<a href="')}}},
  {{'form': 'overlap', 'n': {_count('<p>')} + {_count('<a href="')}}}], recursive := true)
FROM marked)
SELECT page_id, form, n, n AS n_data FROM counted""",
    "element_counts": f"""
WITH opened AS (SELECT page_id, unnest(regexp_extract_all(html, '<[a-z][a-z0-9]*[ >]')) AS m FROM pages),
marked AS (SELECT page_id, {_OPENED} AS marks FROM pages)
SELECT page_id, m[2:-2] AS tag, count(*) AS n, count(*) FILTER (m[-1] = ' ') AS n_attrs FROM opened
WHERE m[2:-2] <> 'b' GROUP BY ALL
UNION ALL
SELECT page_id, 'b', {_ARTICLE_B} + least({_ALL_B}, 3), 0 FROM marked WHERE {_ALL_B} > 0""",
    "robots_allowed": f"""
WITH {_LINKS}
SELECT page_id, dst, CASE
  WHEN host LIKE '%.org' THEN false
  WHEN host LIKE 'm.%' THEN false
  WHEN host LIKE 'www.%' THEN href LIKE '/the%' OR href NOT LIKE '/th%'
  WHEN host LIKE 'blog.%' THEN (href LIKE '/w%re') OR href NOT LIKE '/%e'
  ELSE true END AS ok
FROM links""",
    "host_domain": f"""
SELECT page_id, {_HOST} AS host, string_split({_HOST}, '.')[-2] AS domain,
       'https://' || {_HOST} || '/robots.txt' AS robots
FROM pages""",
    "crawl_frontier": """
WITH RECURSIVE total AS (SELECT count(*) AS n FROM pages),
links AS (
  SELECT page_id AS src, (page_id * 7 + 1) % n AS dst FROM pages, total
  UNION SELECT page_id, (page_id * 3 + 2) % n FROM pages, total),
walk(site, url, depth) AS (
  SELECT CASE WHEN page_id % 10 = 0 THEN 'a' ELSE 'b' END, page_id, 0 FROM pages WHERE page_id % 10 IN (0, 5)
  UNION
  SELECT site, dst, depth + 1 FROM walk JOIN links ON src = url WHERE depth < 3)
SELECT site, url::VARCHAR AS url, min(depth) AS depth FROM walk GROUP BY site, url""",
    "site_crawl": f"""
WITH RECURSIVE half AS (SELECT count(*) // 2 AS n FROM pages),
targets AS (
  SELECT page_id AS src, 0 AS i, 't' AS kind, 2 * ((page_id * 7 + 1) % n) AS dst FROM pages, half
  UNION ALL SELECT page_id, 1, 't', 2 * ((page_id * 5 + 3) % n) FROM pages, half
  UNION ALL SELECT page_id, 0, 's', 2 * ((page_id * 3 + 2) % n) + 1 FROM pages, half
  UNION ALL SELECT page_id, 1, 's', 2 * ((page_id * 11 + 5) % n) + 1 FROM pages, half),
links AS (
  SELECT src, i, kind, dst FROM targets JOIN pages ON page_id = dst
  WHERE NOT regexp_matches(url, '^https?://[^/?#]*/de/')),
walk(site, page, depth) AS (
  SELECT page_id, page_id, 0 FROM pages
  WHERE page_id % 20 = 0 AND {_HOST} NOT LIKE '%.org' AND NOT regexp_matches(url, '^https?://[^/?#]*/de/')
  UNION
  SELECT site, dst, depth + 1 FROM walk JOIN links ON src = page AND kind = 't' WHERE depth < 3),
reached AS (SELECT site, page, min(depth) AS depth FROM walk GROUP BY site, page),
found AS (
  SELECT r.site, r.depth, p.url AS src, l.i, l.dst,
         row_number() OVER (PARTITION BY r.site, l.dst ORDER BY r.depth, p.url, l.i) AS k
  FROM reached r JOIN links l ON l.src = r.page AND l.kind = 's' JOIN pages p ON p.page_id = r.page),
ranked AS (
  SELECT site, dst, row_number() OVER (PARTITION BY site ORDER BY depth, src, i)::INTEGER AS rank FROM found WHERE k = 1)
SELECT s.url AS site, rank, sha256(pages.url) AS id, pages.url AS url, {_TITLE.replace('html', 'pages.html')} AS title,
       {_HOST.replace('url', 's.url')} AS source, '{inputs.RUN_TIME}' AS "publishTime"
FROM ranked JOIN pages ON pages.page_id = dst JOIN pages s ON s.page_id = site WHERE rank <= 7""",
    "failed_fetches": f"""
WITH {_LINKS}
SELECT DISTINCT dst AS url FROM links WHERE dst NOT IN (SELECT url FROM pages)""",
    "site_configs": f"""
SELECT 'https://' || host AS "baseUrl", CASE
  WHEN host LIKE 'm.%' THEN 'a[href^=''/t'']'
  WHEN host LIKE 'www.%' THEN 'li > a[href*=th]'
  WHEN host LIKE 'blog.%' THEN 'a[href~=^/[A-Z]]'
  ELSE 'nav > ul > li > a[href]' END AS selector,
  1 AS n_topics, 'h1' AS "articleTitle", 3 AS "maxDepth"
FROM (SELECT DISTINCT {_HOST} AS host FROM pages)""",
}
