"""Exact duplicates by naming blocks: equal names mean equal texts, without exception.

A text, white space runs made one space, is cut into blocks of ``BLOCK`` code points.

1. The distinct blocks of the corpus are sorted within their partitions and numbered:
   block names. To bring a name back to where its block occurs without moving texts a
   second time, blocks carry a 128-bit route; that no two blocks share a route is
   verified over the whole corpus, and other routes are tried if some do.
2. Neighbouring names are paired and the distinct pairs numbered in the same way, until
   a text has one name. Level and name are its identity.
3. The identity groups the documents.

Blocks are combined before they are shuffled, and joins of a name to its occurrences
can be split, so a third of all rows may be one text. Null counts as empty, which is one
empty block. Rows without ``doc_id`` come after all others; of rows tied in the id one
stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dateline.session import cut

BLOCK = 4096
ROUTES = 4


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _route(block: str, attempt: int) -> list[Column]:
    return [F.xxhash64(F.lit(2 * attempt + i), block).alias(name) for i, name in enumerate("ab")]


def _blocks(size: int) -> Column:
    found = F.regexp_extract_all(F.col("norm"), F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    return F.when(F.col("norm") == "", F.array(F.lit(""))).otherwise(found)


def _numbered(distinct: DataFrame, *order: str) -> DataFrame:
    """Rows with an integer name each: their place in sorted partitions."""
    return distinct.sortWithinPartitions(*order).withColumn("name", F.monotonically_increasing_id())


def identities(docs: DataFrame, size: int = BLOCK) -> DataFrame:
    """``row, doc_id, text_sha256, level, name``: one row a document. Runs jobs."""
    normal = docs.select("doc_id", normalised(F.col("text")).alias("norm"))
    for attempt in range(ROUTES):
        blocks = normal.select(F.explode(_blocks(size)).alias("block")).distinct()
        names = cut(_numbered(blocks, "block").select("name", *_route("block", attempt)), "names")
        if names.groupBy("a", "b").count().where("count > 1").isEmpty():
            break
    else:
        raise RuntimeError("blocks share routes in every attempt")
    placed = normal.withColumn("row", F.monotonically_increasing_id()).select(
        "row", "doc_id", F.sha2("norm", 256).alias("text_sha256"), _blocks(size).alias("blocks")
    )
    placed = placed.select(
        "row", "doc_id", "text_sha256", F.size("blocks").alias("n"), F.posexplode("blocks").alias("pos", "block")
    )
    places = cut(
        placed.select("row", "doc_id", "text_sha256", "n", "pos", *_route("block", attempt)), "places"
    )
    state = cut(places.join(names, ["a", "b"]).select("row", "n", "pos", "name"), "level")
    whole, level = [], 0
    while True:
        whole.append(state.where("n = 1").select("row", F.lit(level).alias("level"), "name"))
        parts = state.where("n > 1")
        if parts.isEmpty():
            break
        odd = F.col("pos") % 2 == 1
        pairs = cut(
            parts.groupBy("row", "n", F.floor(F.col("pos") / 2).alias("pos")).agg(
                F.max(F.when(~odd, F.col("name"))).alias("left"),
                F.coalesce(F.max(F.when(odd, F.col("name"))), F.lit(-1)).alias("right"),
            ),
            "pairs",
        )
        names = cut(_numbered(pairs.select("left", "right").distinct(), "left", "right"), "names")
        state = cut(
            pairs.join(names, ["left", "right"]).select("row", F.ceil(F.col("n") / 2).alias("n"), "pos", "name"),
            "level",
        )
        level += 1
    found = whole[0]
    for more in whole[1:]:
        found = found.unionByName(more)
    return places.where("pos = 0").select("row", "doc_id", "text_sha256").join(found, "row")


def duplicates(docs: DataFrame, size: int = BLOCK) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256``, one row a document. Runs jobs."""
    members = cut(identities(docs, size), "members")
    groups = members.groupBy("level", "name").agg(
        F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("first"),
        F.count("*").alias("group_size"),
    )
    # As a table of its own the groups leave Spark free to split a hot one's members.
    return members.join(cut(groups, "groups"), ["level", "name"]).select(
        "doc_id",
        F.col("first.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("first.row")).alias("kept"),
        "text_sha256",
    )
