import json
import os

from pyspark.sql import functions as F

from dateline.operators.timeline import slots
from dateline.streaming.feeds import (
    article_stream,
    left_out,
    run_available,
    slot_counts,
    undated,
    without_repeats,
)


def write(folder, name, rows):
    lines = [
        json.dumps({"id": i, "title": t, "body": "b", "source": s, "publishTime": at, "crawledAt": at}) for i, t, s, at in rows
    ]
    (folder / name).write_text("\n".join(lines) + "\n")


RUNS = {
    "run1.json": [("1", "a", "x", "2025-01-01 00:10:00"), ("2", "b", "x", "2025-01-01 01:00:00"), ("1", "a", "x", "2025-01-01 00:20:00")],
    "run2.json": [("2", "b", "x", "2025-01-01 01:05:00"), ("3", "c", "y", "2025-01-01 03:00:00")],
    "run3.json": [("4", "d", "y", "2025-01-05 00:00:00")],
}


def in_order(folder, *names):
    """Give the files times one minute apart, which is the order a stream takes them in."""
    for k, name in enumerate(names):
        os.utime(folder / name, (1_700_000_000 + 60 * k,) * 2)


def test_repeats_across_runs_and_closed_slots(spark, tmp_path):
    for name, rows in RUNS.items():
        write(tmp_path, name, rows)
    in_order(tmp_path, *RUNS)
    stream = article_stream(spark, str(tmp_path), files_per_trigger=1)
    once = run_available(without_repeats(stream, "id", "crawled_ts"), "once")
    assert sorted(r["id"] for r in once.collect()) == ["1", "2", "3", "4"]
    counts = run_available(slot_counts(without_repeats(stream, "id", "crawled_ts"), "crawled_ts", "source"), "slots")
    got = {(str(r["slot_start"]), r["source"], r["n"]) for r in counts.collect()}
    # The slot of the last day stays open; the others equal the batch result.
    batch = slots(once, "crawled_ts", "source").where("slot_end <= '2025-01-04 00:00:00'")
    assert got == {(str(r["slot_start"]), r["source"], r["n"]) for r in batch.collect()}
    assert got == {("2025-01-01 00:00:00", "x", 2), ("2025-01-01 02:00:00", "y", 1)}


def test_empty_folder_gives_no_rows(spark, tmp_path):
    stream = article_stream(spark, str(tmp_path))
    assert run_available(without_repeats(stream, "id", "crawled_ts"), "none").count() == 0


def test_late_rows_are_dropped(spark, tmp_path):
    write(tmp_path, "1.json", [("1", "a", "x", "2025-01-10 00:00:00")])
    first = article_stream(spark, str(tmp_path), files_per_trigger=1)
    (tmp_path / "2.json").write_text("")
    write(tmp_path, "3.json", [("2", "b", "x", "2025-01-08 00:00:00"), ("3", "c", "x", "2025-01-09 12:00:00")])
    in_order(tmp_path, "1.json", "2.json", "3.json")
    dropped = []
    kept = run_available(without_repeats(first, "id", "crawled_ts").select("id", F.col("crawled_ts")), "late", dropped=dropped)
    assert sorted(r["id"] for r in kept.collect()) == ["1", "3"]
    assert sum(dropped) == 1
    table = spark.read.schema(first.schema).json(str(tmp_path))
    assert [r["id"] for r in left_out(table, kept, "id").collect()] == ["2"]


def test_bad_times_and_missing_ids(spark, tmp_path):
    at = "2025-01-10 00:00:00"
    write(tmp_path, "1.json", [("1", "a", "x", at), ("2", "b", "x", "yesterday"), ("3", "c", "x", None), (None, "d", "x", at), (None, "e", "x", at)])
    stream = article_stream(spark, str(tmp_path))
    kept = run_available(without_repeats(stream, "id", "crawled_ts").select("id", "title"), "kept").collect()
    # The two without an id have one body, so they are one article.
    assert sorted(r["id"] or "" for r in kept) == ["", "1"]
    rest = run_available(undated(stream, "crawled_ts").select("id"), "undated").collect()
    assert sorted(r["id"] for r in rest) == ["2", "3"]
