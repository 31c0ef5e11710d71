from pyspark.sql import functions as F

from dateline.functions import text
from dateline.functions.urls import absolute_url, base_parts


def values(spark, rows, column, schema="s string"):
    frame = spark.createDataFrame([r if isinstance(r, tuple) else (r,) for r in rows], schema)
    return [r[0] for r in frame.select(column.alias("v")).collect()]


def test_strip_takes_the_blanks_python_takes(spark):
    samples = ["", " ", " a b　", "\x1c\x1da\n b\x85", "​a​", " x \t", "a"]
    assert values(spark, samples, text.strip(F.col("s"))) == [s.strip() for s in samples]


def test_java_trim_takes_control_characters_only(spark):
    samples = ["\x00\x01 a \x1f", " a ", " \t\n"]
    assert values(spark, samples, text.java_trim(F.col("s"))) == ["a", " a ", ""]


def test_bodies(spark):
    samples = [None, "", " \n", "a\nb\n", " x"]
    assert values(spark, samples, text.has_body(F.col("s"))) == [False, False, False, True, True]
    assert values(spark, ["a\nb\r\nc\n "], text.clean_body(F.col("s"))) == ["a b\r c"]


def test_hosts_and_domains(spark):
    urls = ["https://www.bbc.com/news", "http://www.bbc.co.uk:8080/x?y#z", "https://localhost/", "no url", None]
    assert values(spark, urls, text.host_of(F.col("s"))) == [
        "www.bbc.com", "www.bbc.co.uk", "localhost", "unknown", "unknown"
    ]
    hosts = ["www.bbc.com", "www.bbc.co.uk", "localhost"]
    assert values(spark, hosts, text.domain_label(F.col("s"))) == ["bbc", "co", None]
    assert values(spark, ["a.b"], text.robots_url(F.col("s"))) == ["https://a.b/robots.txt"]


def test_ids(spark):
    import hashlib

    def sha(s):
        return hashlib.sha256(s.encode()).hexdigest()

    assert values(spark, ["https://x/é"], text.article_id(F.col("s"))) == [sha("https://x/é")]
    rows = [("i", "b"), (None, "b")]
    assert values(spark, rows, text.embedding_id(F.col("i"), F.col("b")), "i string, b string") == [sha("i"), sha("b")]


def test_batch_names(spark):
    ts = F.lit("2025-11-04 05:06:07").cast("timestamp")
    name = text.batch_name(ts, F.col("s"), text.file_suffix(F.lit("JSONL")))
    assert values(spark, ["bbc"], name) == ["articles_2025Y11M04D_05h06m07s_bbc.jsonl"]
    shared = text.batch_name(ts, F.col("s"), text.file_suffix(F.lit("PARQUET")), per_site=False)
    assert values(spark, ["bbc"], shared) == ["articles_2025Y11M04D_05h06m07s.parquet"]
    assert values(spark, ["JSON", "XML"], text.file_suffix(F.col("s"))) == [".json", None]


def test_display_name(spark):
    row = [("1", "bbc", "T")]
    shown = text.display_name(F.col("i"), F.col("s"), F.col("t"))
    assert values(spark, row, shown, "i string, s string, t string") == ["(1) bbc - T"]


def test_absolute_urls(spark):
    base = "https://h.com/a/b/page.html?q=1#top"
    cases = [
        (base, "https://o.org/x", "https://o.org/x"),
        (base, "http://o.org/a/../b/./c", "http://o.org/b/c"),
        (base, "//o.org/x", "https://o.org/x"),
        (base, "/x/y?z#f", "https://h.com/x/y?z#f"),
        (base, "x", "https://h.com/a/b/x"),
        (base, "../x", "https://h.com/a/x"),
        (base, "../../../x", "https://h.com/x"),
        (base, "./", "https://h.com/a/b/"),
        (base, "..", "https://h.com/a/"),
        (base, "?p=2", "https://h.com/a/b/page.html?p=2"),
        (base, "#f", "https://h.com/a/b/page.html?q=1#f"),
        (base, "", base),
        (base, " /x ", "https://h.com/x"),
        (base, "/x?r=/../y", "https://h.com/x?r=/../y"),
        (base, "mailto:a@b.c", "mailto:a@b.c"),
        (base, "javascript:void(0)", "javascript:void(0)"),
        (base, None, ""),
        ("https://h.com", "x", "https://h.com/x"),
        ("not a url", "x", ""),
        ("not a url", "https://o.org/x", "https://o.org/x"),
    ]
    frame = spark.createDataFrame(cases, "b string, r string, want string")
    parts = frame.withColumn("p", F.expr(base_parts("b")))
    for row in parts.select("r", "want", F.expr(absolute_url("p", "r")).alias("got")).collect():
        assert row["got"] == row["want"], row
