"""Stored articles: cleaning, ids, attributes, duplicates, files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from dateline.functions.text import article_id, display_name, embedding_id, file_suffix, time_text
from dateline.operators.articles import headline_view, latest, live
from dateline.plans import inputs
from dateline.schemas import ARTICLE
from dateline.session import scratch_path
from dateline.sources.articles import (
    read_articles,
    with_batch,
    with_clean_body,
    write_json_by_id,
    write_jsonl,
    write_parquet,
)
from dateline.sources.vectors import attrs_of
from dateline.streaming.feeds import article_stream, run_available, without_repeats


def _crawled(key: str) -> F.Column:
    seconds = F.col(key) * 7919 % 100000
    return F.timestamp_seconds(F.lit(1767225600) + seconds)


def _articles(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as stored articles; every ninth body is blank."""
    docs = inputs.documents(spark, folder)
    url = F.concat(F.lit("https://"), "source", F.lit(".example.com/"), "doc_id")
    body = F.when(F.col("doc_id") % 9 == 4, F.lit(" \n ")).otherwise(
        F.concat(F.lit(" \n"), "text", F.lit("\n \x1c"))
    )
    return docs.select(
        "doc_id",
        article_id(url).alias("id"),
        url.alias("url"),
        F.concat(F.lit("Title "), F.col("doc_id") % 100).alias("title"),
        body.alias("body"),
        "source",
        time_text(_crawled("doc_id") - F.expr("interval 1 hour")).alias("publishTime"),
        time_text(_crawled("doc_id")).alias("crawledAt"),
    )


def clean_bodies(spark: SparkSession, folder: str) -> DataFrame:
    rows = _articles(spark, folder)
    first, second = rows.where("doc_id % 2 = 0"), rows.where("doc_id % 2 = 1")
    return with_clean_body(first.unionByName(second)).select("doc_id", "body")


def article_attrs(spark: SparkSession, folder: str) -> DataFrame:
    docs = inputs.documents(spark, folder).select(
        "doc_id",
        F.col("text").alias("body"),
        "lang",
        F.col("n_chars").alias("size"),
        F.when(F.col("doc_id") % 3 == 0, F.col("source")).alias("source"),
        F.array("lang", "source").alias("tags"),
        (F.col("doc_id") % 2 == 0).alias("even"),
    )
    attrs = docs.withColumn("attrs", attrs_of(docs, ("body", "doc_id")))
    return attrs.select("doc_id", F.explode("attrs").alias("k", "v"))


def article_json(spark: SparkSession, folder: str) -> DataFrame:
    """Articles encoded as JSON, decoded again field by field."""
    rows = _articles(spark, folder)
    encoded = rows.select("doc_id", F.to_json(F.struct("id", "title", "source", "crawledAt")).alias("line"))
    back = F.from_json("line", "id string, title string, source string, crawledAt string")
    return encoded.select("doc_id", "line", back.alias("a")).select("doc_id", "line", "a.title", "a.crawledAt")


def embedding_ids(spark: SparkSession, folder: str) -> DataFrame:
    rows = with_clean_body(_articles(spark, folder)).withColumn(
        "id", F.when(F.col("doc_id") % 5 != 0, F.col("id"))
    )
    return rows.select("doc_id", embedding_id(F.col("id"), F.col("body")).alias("embedding_id"))


def latest_article(spark: SparkSession, folder: str) -> DataFrame:
    """One row per text: copies are the same article crawled again."""
    docs = inputs.documents(spark, folder)
    rows = docs.select(
        F.sha2("text", 256).alias("id"), "doc_id", "source", time_text(_crawled("doc_id")).alias("crawledAt")
    )
    return latest(rows, "id", "crawledAt", "doc_id")


def display_names(spark: SparkSession, folder: str) -> DataFrame:
    rows = _articles(spark, folder)
    return rows.select("doc_id", display_name(F.col("id"), F.col("source"), F.col("title")).alias("shown"))


def headlines(spark: SparkSession, folder: str) -> DataFrame:
    rows = _articles(spark, folder)
    return headline_view(rows, F.to_timestamp("publishTime", "yyyy-MM-dd HH:mm:ss"))


def expire_1d(spark: SparkSession, folder: str) -> DataFrame:
    rows = inputs.documents(spark, folder).select("doc_id", "source", _crawled("doc_id").alias("crawled_ts"))
    as_of = F.lit("2026-01-02 00:30:00").cast("timestamp")
    return live(rows, as_of).select("doc_id", "source", time_text(F.col("crawled_ts")).alias("crawledAt"))


def source_counts(spark: SparkSession, folder: str) -> DataFrame:
    rows = with_clean_body(_articles(spark, folder))
    return rows.groupBy("source").agg(F.count("*").alias("n"))


def batch_names(spark: SparkSession, folder: str) -> DataFrame:
    fmt = F.element_at(F.array(F.lit("JSON"), F.lit("JSONL"), F.lit("PARQUET")), (F.col("event_id") % 3 + 1).cast("int"))
    host = F.concat(F.lit("www."), "event_type", F.lit(".example.com"))
    rows = inputs.events(spark, folder).select("event_id", "ts", fmt.alias("fmt"), host.alias("host"))
    named = [
        with_batch(rows.where(F.col("fmt") == name), F.col("host"), F.col("ts"), name)
        for name in ("JSON", "JSONL", "PARQUET")
    ]
    every = named[0].unionByName(named[1]).unionByName(named[2])
    return every.select("event_id", "batch", "domain", file_suffix(F.col("fmt")).alias("suffix"))


def stream_articles(spark: SparkSession, folder: str) -> DataFrame:
    """JSON-lines articles as a stream, one per id: copies of a text are repeats."""
    path = scratch_path(spark, "runs")
    text = F.col("text")
    rows = inputs.documents(spark, folder).select(
        F.sha2(text, 256).alias("id"), F.lit("u").alias("url"), F.lit("t").alias("title"), text.alias("body"), "source",
        F.when(F.col("doc_id") % 2 == 0, time_text(_crawled("doc_id"))).alias("publishTime"),
        time_text(_crawled("n_chars")).alias("crawledAt"),
    )
    write_jsonl(rows, path)
    once = run_available(without_repeats(article_stream(spark, path), "id", "crawled_ts"), "stream")
    return once.select("id", "body", time_text(F.col("crawled_ts")).alias("crawledAt"))


def jsonl_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Written as JSON lines, read back as the loader does (blank bodies drop out), beside
    files with repeated, blank and malformed lines."""
    path, other = scratch_path(spark, "jsonl"), scratch_path(spark, "lines")
    rows = _articles(spark, folder).withColumn("title", F.when(F.col("doc_id") % 7 != 0, F.col("title")))
    write_jsonl(rows, path, ("source",))
    line = F.to_json(F.struct(*[c for c in ARTICLE.fieldNames() if c != "source"]), {"ignoreNullFields": "false"})
    kind = F.col("doc_id") % 5
    lines = F.when(kind == 0, line).when(kind == 1, F.lit(" \t")).when(kind == 2, F.substring(line, 1, 40))
    rows.where("doc_id % 5 < 3").select(lines.alias("value")).write.option("compression", "none").text(other)
    # The sinks' files end in .json and .txt; the loader reads any name given by its pattern.
    read = read_articles(spark, path).unionByName(read_articles(spark, other, suffix="*.txt"))
    return read.select("id", "title", "crawledAt", F.sha2("body", 256).alias("body_hash"), F.size("attrs").alias("n_attrs"))


def parquet_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "parquet")
    write_parquet(_articles(spark, folder), path)
    return (
        spark.read.parquet(path)
        .where(F.col("source").isin("src1", "src2", "src3"))
        .select("id", "url", "source", "crawledAt")
    )


def json_by_id_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "by-id")
    write_json_by_id(_articles(spark, folder), path)
    back = spark.read.schema(StructType([*ARTICLE.fields, StructField("prefix", StringType())])).json(path)
    body = F.sha2("body", 256).alias("body_hash")
    return back.select("prefix", "id", "url", "title", body, "source", "publishTime", "crawledAt")


QUERIES = {
    "clean_bodies": clean_bodies,
    "article_attrs": article_attrs,
    "article_json": article_json,
    "embedding_id": embedding_ids,
    "latest_article": latest_article,
    "display_names": display_names,
    "ui_articles": headlines,
    "expire_1d": expire_1d,
    "source_counts": source_counts,
    "batch_name": batch_names,
    "stream_articles": stream_articles,
    "jsonl_roundtrip": jsonl_roundtrip,
    "parquet_roundtrip": parquet_roundtrip,
    "json_by_id_roundtrip": json_by_id_roundtrip,
}

_CRAWLED = "TIMESTAMP '2026-01-01 00:00:00' + to_seconds(doc_id * 7919 % 100000)"
_STAMP = "'%Y-%m-%d %H:%M:%S'"
_BLANKS = "chr(9) || chr(10) || chr(13) || ' ' || chr(28) || chr(29) || chr(30) || chr(31) || chr(160) || chr(8195) || chr(11) || chr(12)"
_ART = f"""
articles AS (
  SELECT doc_id, sha256('https://' || source || '.example.com/' || doc_id) AS id,
         'https://' || source || '.example.com/' || doc_id AS url, 'Title ' || (doc_id % 100) AS title,
         CASE WHEN doc_id % 9 = 4 THEN ' ' || chr(10) || chr(8195)
              ELSE chr(160) || chr(10) || text || chr(10) || chr(8195) || chr(28) END AS body,
         source, strftime({_CRAWLED} - INTERVAL 1 HOUR, {_STAMP}) AS "publishTime",
         strftime({_CRAWLED}, {_STAMP}) AS "crawledAt"
  FROM documents),
cleaned AS (
  SELECT * REPLACE (trim(replace(body, chr(10), ' '), {_BLANKS}) AS body)
  FROM articles WHERE trim(body, {_BLANKS}) <> '')"""

SQL = {
    "clean_bodies": f"WITH {_ART} SELECT doc_id, body FROM cleaned",
    "article_attrs": """
SELECT doc_id, unnest([
  {'k': 'lang', 'v': lang}, {'k': 'size', 'v': n_chars::VARCHAR},
  {'k': 'source', 'v': CASE WHEN doc_id % 3 = 0 THEN source ELSE 'null' END},
  {'k': 'tags', 'v': '["' || lang || '","' || source || '"]'},
  {'k': 'even', 'v': CASE WHEN doc_id % 2 = 0 THEN 'true' ELSE 'false' END}], recursive := true)
FROM documents""",
    "article_json": f"""
WITH {_ART}
SELECT doc_id, '{{"id":"' || id || '","title":"' || title || '","source":"' || source || '","crawledAt":"' || "crawledAt" || '"}}' AS line,
       title, "crawledAt" FROM articles""",
    "embedding_id": f"""
WITH {_ART}
SELECT doc_id, sha256(CASE WHEN doc_id % 5 <> 0 THEN id ELSE body END) AS embedding_id FROM cleaned""",
    "latest_article": f"""
SELECT id, doc_id, source, "crawledAt" FROM (
  SELECT sha256(text) AS id, doc_id, source, strftime({_CRAWLED}, {_STAMP}) AS "crawledAt",
         row_number() OVER (PARTITION BY text ORDER BY {_CRAWLED} DESC, doc_id) AS k
  FROM documents) WHERE k = 1""",
    "display_names": f"WITH {_ART} SELECT doc_id, '(' || id || ') ' || source || ' - ' || title AS shown FROM articles",
    "ui_articles": f"""
WITH {_ART}
SELECT title, source, url, epoch_ms(strptime("publishTime", {_STAMP})) AS "timestamp" FROM articles""",
    "expire_1d": f"""
SELECT doc_id, source, strftime({_CRAWLED}, {_STAMP}) AS "crawledAt" FROM documents
WHERE {_CRAWLED} > TIMESTAMP '2026-01-01 00:30:00' AND {_CRAWLED} <= TIMESTAMP '2026-01-02 00:30:00'""",
    "source_counts": f"WITH {_ART} SELECT source, count(*) AS n FROM cleaned GROUP BY source",
    "batch_name": """
SELECT event_id, 'articles_' || strftime(ts, '%YY%mM%dD_%Hh%Mm%Ss') || '_example' || suffix AS batch,
       'example' AS domain, suffix
FROM (SELECT *, CASE event_id % 3 WHEN 0 THEN '.json' WHEN 1 THEN '.jsonl' ELSE '.parquet' END AS suffix FROM events)""",
    "stream_articles": """
SELECT DISTINCT sha256(text) AS id, text AS body,
       strftime(make_timestamp((1767225600 + n_chars * 7919 % 100000) * 1000000), '%Y-%m-%d %H:%M:%S') AS "crawledAt"
FROM documents""",
    "jsonl_roundtrip": f"""
WITH {_ART}
SELECT id, CASE WHEN doc_id % 7 <> 0 THEN title END AS title, "crawledAt", sha256(body) AS body_hash,
       5 AS n_attrs FROM cleaned, range(2) copies(k) WHERE k = 0 OR doc_id % 5 = 0""",
    "parquet_roundtrip": f"""
WITH {_ART} SELECT id, url, source, "crawledAt" FROM articles WHERE source IN ('src1', 'src2', 'src3')""",
    "json_by_id_roundtrip": f"""
WITH {_ART} SELECT substr(id, 1, 2) AS prefix, id, url, title, sha256(body) AS body_hash, source, "publishTime", "crawledAt"
FROM articles""",
}
