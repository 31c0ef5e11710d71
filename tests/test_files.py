import json

import pytest
from pyspark.sql import functions as F

from dateline.operators.articles import headline_view, latest, live
from dateline.operators.timeline import latest_slot, slots
from dateline.schemas import ARTICLE
from dateline.sources.articles import (
    read_articles,
    rejected_articles,
    with_batch,
    write_batch,
    write_json_by_id,
    write_jsonl,
    write_parquet,
)
from dateline.sources.configs import read_site_configs, rejected_site_configs

LINES = [
    {"id": "1", "url": "u1", "title": "T1", "body": "one\ntwo ", "source": "s", "publishTime": "p", "crawledAt": "2025-01-01 00:00:00"},
    {"id": "2", "title": "blank", "body": "  \n"},
    {"id": "3", "title": "no body"},
    {"id": "4", "title": "null body", "body": None},
    {"title": None, "body": "no id", "extra": {"a": [1, 2]}, "score": 1.5, "flag": True},
    {"id": "1", "url": "u1", "title": "T1b", "body": "again", "crawledAt": "2025-01-02 00:00:00"},
]


@pytest.fixture
def folder(tmp_path):
    lines = [json.dumps(x) for x in LINES]
    (tmp_path / "a.jsonl").write_text("\n".join([lines[0], "", "   ", *lines[1:3]]) + "\n")
    (tmp_path / "b.jsonl").write_text("\n".join([*lines[3:], '{"id": "9", "body": '] ) + "\n")
    (tmp_path / "c.txt").write_text(lines[0])
    return str(tmp_path)


def test_read_articles(spark, folder):
    rows = {r["title"]: r for r in read_articles(spark, folder).collect()}
    assert set(rows) == {"T1", "T1b", None}
    assert rows["T1"]["body"] == "one two"
    assert rows["T1"]["file"].endswith("a.jsonl")
    assert rows[None]["attrs"] == {"title": "null", "extra": '{"a":[1,2]}', "score": "1.5", "flag": "true"}
    rejected = rejected_articles(spark, folder).collect()
    assert [r["line"] for r in rejected] == ['{"id": "9", "body": ']
    with pytest.raises(Exception, match="(?i)malformed"):
        read_articles(spark, folder, strict=True).collect()


def test_latest_and_expiry(spark, folder):
    rows = read_articles(spark, folder).where("id is not null")
    assert [r["title"] for r in latest(rows).collect()] == ["T1b"]
    twice = latest(rows.unionByName(rows))
    assert [r["title"] for r in twice.collect()] == ["T1b"]
    timed = rows.withColumn("crawled_ts", F.to_timestamp("crawledAt"))
    assert [r["title"] for r in live(timed, F.lit("2025-01-02 00:00:00").cast("timestamp")).collect()] == ["T1b"]
    shown = headline_view(rows.where("title = 'T1'"), F.lit("1970-01-01 00:00:01").cast("timestamp")).first()
    assert tuple(shown) == ("T1", "s", "u1", 1000)


def test_sinks(spark, folder, tmp_path):
    rows = read_articles(spark, folder)
    out = str(tmp_path / "out")
    write_jsonl(rows, out)
    write_jsonl(rows, out)
    lines = [json.loads(r["value"]) for r in spark.read.text(out).collect()]
    assert len(lines) == 6
    assert all(list(line) == ARTICLE.fieldNames() for line in lines)
    assert any(line["id"] is None for line in lines)
    write_parquet(rows.withColumn("source", F.lit("x")), str(tmp_path / "pq"))
    assert spark.read.parquet(str(tmp_path / "pq")).where("source = 'x'").count() == 3
    write_json_by_id(rows.withColumn("id", F.sha2("title", 256)).where("id is not null"), str(tmp_path / "id"))
    assert spark.read.json(str(tmp_path / "id")).count() == 2


def test_articles_without_an_id_and_ties(spark):
    at = "2025-01-01 00:00:00"
    rows = spark.createDataFrame([(None, "one", at), (None, "two", at), (None, "one", at), ("7", "x", at), ("7", "y", at)], "id string, body string, crawledAt string")
    first = sorted((r["id"] or "", r["body"]) for r in latest(rows).collect())
    assert [b for _, b in first[:2]] == ["one", "two"] and len(first) == 3
    assert sorted((r["id"] or "", r["body"]) for r in latest(rows.orderBy(F.desc("body")).repartition(3)).collect()) == first


def test_a_batch_is_read_back_by_default(spark, tmp_path):
    rows = spark.createDataFrame([(f"{k}", "https://www.mill.test/x", "T", "b", "s", None, "2025-01-01 00:00:00") for k in range(3)], ARTICLE)
    write_batch(rows, str(tmp_path / "out"), F.lit("www.mill.test"), F.lit("2025-11-04 05:06:07").cast("timestamp"))
    got = spark.read.json(str(tmp_path / "out")).select("domain", "batch").distinct().collect()
    assert [tuple(r) for r in got] == [("mill", "articles_2025Y11M04D_05h06m07s_mill.json")]
    files = str(tmp_path / "out/domain=mill/batch=articles_2025Y11M04D_05h06m07s_mill.json")
    assert read_articles(spark, files).count() == 3


def test_batch_partitions(spark, tmp_path):
    rows = spark.createDataFrame([("1", "www.mill.test")], "id string, host string")
    run = F.lit("2025-11-04 05:06:07").cast("timestamp")
    named = with_batch(rows, F.col("host"), run, "PARQUET").first()
    assert (named["batch"], named["domain"]) == ("articles_2025Y11M04D_05h06m07s_mill.parquet", "mill")


def test_site_configs(spark, tmp_path):
    good = {"baseUrl": "https://journal.mill.test/daily", "topicSelectors": ["a"], "articleSelectors": ["b", "c"],
            "articleTitle": "h1", "articleTime": "time", "articleBody": "p", "maxDepth": 7}
    (tmp_path / "good.json").write_text(json.dumps(good, indent=2))
    (tmp_path / "bad.json").write_text('{"baseUrl": ')
    (tmp_path / "other.txt").write_text(json.dumps(good))
    rows = read_site_configs(spark, str(tmp_path)).collect()
    assert [(r["baseUrl"], r["articleSelectors"], r["maxDepth"]) for r in rows] == [("https://journal.mill.test/daily", ["b", "c"], 7)]
    assert [r["file"].endswith("bad.json") for r in rejected_site_configs(spark, str(tmp_path)).collect()] == [True]
    with pytest.warns(UserWarning, match="no configuration folder"):
        assert read_site_configs(spark, str(tmp_path / "missing")).count() == 0


def test_timeline(spark):
    rows = spark.createDataFrame([("2025-01-01 01:59:59",), ("2025-01-01 02:00:00",), ("2025-01-01 03:30:00",)], "t string")
    rows = rows.select(F.col("t").cast("timestamp").alias("ts"))
    counts = [(str(r["slot_start"]), r["n"]) for r in slots(rows, "ts").orderBy("slot_start").collect()]
    assert counts == [("2025-01-01 00:00:00", 1), ("2025-01-01 02:00:00", 2)]
    assert latest_slot(rows, "ts", F.lit("2025-01-01 04:00:00").cast("timestamp")).count() == 1
    assert slots(rows, "ts", slide="1 hour").agg(F.sum("n")).first()[0] == 6
