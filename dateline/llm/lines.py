"""Repeated lines across documents, with DataFrame functions only.

Every text is split at line feeds. A line's key is the line without white space at both
ends, A-Z lower-cased. Keys of at least ``least`` code points that more than ``most``
documents hold lose all their lines, except in the smallest ``doc_id`` holding them.

1. Keys travel as two 64-bit hashes. One aggregation, combined before the shuffle,
   finds each key's smallest and largest document (and their number when ``most`` > 1).
2. The keys that are shared are joined back to the lines, which gives the positions to
   drop; a key in a third of all lines is a skewed join side, which Spark splits.
3. Positions are gathered per text and taken from its lines by position.

Null and empty texts are one empty line. Rows of one ``doc_id`` are one document, each
row judged by itself; rows without an id are one document that comes after all others.
Other columns pass through unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dateline.session import broadcast_within, cut

BLANK = "\t\n\x0b\f\r "
LEAST = 10
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """Trimmed, A-Z lower-cased; the quick ``lower`` serves lines of ASCII only."""
    bare = F.btrim(line, F.lit(BLANK))
    ascii_only = F.octet_length(bare) == F.char_length(bare)
    return F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, _UPPER, _LOWER))


def _keyed(docs: DataFrame, least: int) -> DataFrame:
    """``doc_id, mark, pos, a, b`` of every line long enough; ``mark`` tells texts of one id apart."""
    lines = docs.select(
        "doc_id",
        F.xxhash64("text").alias("mark"),
        F.posexplode(F.split(F.col("text"), "\n", -1)).alias("pos", "line"),
    )
    keys = lines.where(F.length("line") >= least).select("doc_id", "mark", "pos", line_key(F.col("line")).alias("key"))
    return keys.where(F.length("key") >= least).select(
        "doc_id", "mark", "pos", F.xxhash64("key").alias("a"), F.xxhash64(F.lit("second"), "key").alias("b")
    )


def shared_keys(docs: DataFrame, least: int = LEAST, most: int = 1) -> DataFrame:
    """``a, b, keeper`` of the keys in more than ``most`` documents."""
    keyed = _keyed(docs, least)
    if most > 1:
        keyed = keyed.select("a", "b", "doc_id").distinct()
        many = F.count("*") > most
    else:
        nameless = F.max(F.col("doc_id").isNull())
        many = (F.min("doc_id") < F.max("doc_id")) | (nameless & F.min("doc_id").isNotNull())
    return (
        keyed.groupBy("a", "b")
        .agg(F.min("doc_id").alias("keeper"), many.alias("many"))
        .where("many")
        .select("a", "b", "keeper")
    )


def dropped_lines(docs: DataFrame, least: int = LEAST, most: int = 1) -> DataFrame:
    """``doc_id, mark, drop``: positions of the lines to drop, for texts that have any."""
    doomed = _keyed(docs, least).join(cut(shared_keys(docs, least, most), "lines"), ["a", "b"])
    return (
        doomed.where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
        .groupBy("doc_id", "mark")
        .agg(F.collect_set("pos").alias("drop"))
    )


def drop_shared_lines(docs: DataFrame, least: int = LEAST, most: int = 1) -> DataFrame:
    """``docs`` with ``text`` cleaned, and ``n_lines`` (before) and ``n_dropped``.

    Runs jobs that write the shared keys and the positions to the shared folder. Texts
    are shuffled only when the positions are too many to broadcast.
    """
    drop = cut(dropped_lines(docs, least, most), "dropped").toDF("_id", "_of", "_drop")
    sized = broadcast_within(drop, F.size("_drop") * 8 + 48)
    # The other columns travel in one struct, whatever they are called.
    marked = docs.select(F.struct(*docs.columns).alias("doc"), "doc_id", "text", F.xxhash64("text").alias("mark"))
    met = marked.join(sized, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_of")), "left")
    split = met.select("doc", F.split(F.coalesce("text", F.lit("")), "\n", -1).alias("lines"), F.col("_drop").alias("drop"))
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "drop")
    some = F.array_join(F.transform(kept, lambda p: F.get("lines", p)), "\n")
    text = F.when(F.col("drop").isNull(), F.array_join("lines", "\n")).otherwise(some)
    return split.select(
        *[text.alias("text") if c == "text" else F.col(f"doc.{c}") for c in docs.columns],
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias("n_dropped"),
    )
