"""Near copies by 64-bit fingerprints, found exactly within two differing bits.

The fingerprint of a text has a bit set when more than half of its shingles' XXH64
hashes have it. Fingerprints at most two bits apart are linked; a document's component
is the smallest id it can reach.

The search is on distinct fingerprints, so copies cost nothing. A fingerprint is cut
into two segments of 32 bits. Of two linked ones,

* one segment is equal: an equality join on that segment finds the pair, and
* else each segment differs in one bit: the pair agrees on a variant of the first segment
  in which one bit is a wildcard. A fingerprint is indexed under its 32 variants, with
  the wildcard's bit deleted and kept aside, and meets those with the other bit.

Each pair is verified inside the join, so only links come out. Skewed segments are
joined in slices by Spark. Components are found by rounds of star contraction, each cut
by a table in the shared folder.

Null and empty texts have no words and the fingerprint zero, linked like any other.
Rows without ``doc_id`` take part; a component of such rows alone has a null id.

``one_of_each`` filters a corpus by another rule: texts whose five-word shingles are at
least 0.8 alike. It too links fingerprints, of the sets of five-word shingles, by segments and
one-wildcard variants, verifies each link by the shingles of the whole texts and contracts
stars. Texts just 0.8 alike differ in a seventh of a fingerprint's bits, too many for any
segment long enough to keep unlike texts apart, so those that the fingerprints leave apart are
searched further: by ``BANDS`` keys, each a hash of ``BAND`` minima of the shingle set under
different orders (two texts 0.8 alike share one with a probability of 0.9996), judged by
a fingerprint of ``64 * PROOF`` bits over the set, then verified in the same way.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from dateline.llm.batches import rows_per_batch
from dateline.llm.words import mix
from dateline.session import broadcast_within, cut

SEED = 42
SHINGLE = 3
BITS_APART = 2
BANDS = 20  # keys of a text in the search for texts alike
BAND = 5  # minima of a key
PROOF = 8  # words of the fingerprint that judges candidates
SIMILARITY = 0.8
SLACK = 3.0  # standard errors that the bits of a pair as similar as asked may differ more
TEXTS = 512  # texts, or pairs of them, that go to Python at a time
CHUNK = 1 << 20  # bytes of a text whose words are held at a time
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def _word_runs(data: bytes, shingle: int) -> Iterator[list[bytes]]:
    """The words in runs that overlap by ``shingle - 1`` words."""
    at, carried = 0, []
    while at < len(data):
        stop = _SPACE.search(data, at + CHUNK)
        end = stop.start() if stop else len(data)
        words = carried + data[at:end].split()
        at = end
        if len(words) >= shingle or at >= len(data):
            yield words
            carried = words[len(words) - shingle + 1 :] if shingle > 1 else []
        else:
            carried = words


def _shingle_hashes(data: bytes, shingle: int) -> Iterator[np.ndarray]:
    """XXH64 of the shingles, run by run; of fewer words, of the whole sequence."""
    short, none = [], True
    for words in _word_runs(data, shingle):
        if len(words) < shingle:
            short = words
            continue
        none = False
        rows = map(b" ".join, zip(*[words[i:] for i in range(shingle)]))
        yield np.fromiter(map(xxh64_intdigest, rows, repeat(SEED)), np.uint64)
    if none and short:
        yield np.array([xxh64_intdigest(b" ".join(short), SEED)], np.uint64)


def _ones(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit; bytes are summed 255 rows at a time."""
    counts = np.zeros(64, np.int64)
    for part in range(0, len(hashes), 255 << 8):
        bits = np.unpackbits(hashes[part : part + (255 << 8)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += np.add.reduceat(bits, np.arange(0, len(bits), 255), axis=0, dtype=np.uint8).sum(0, dtype=np.int64)
    return counts


def _majority(counts: np.ndarray, total: int) -> np.ndarray:
    return np.packbits(counts * 2 > total, axis=-1, bitorder="little").view(np.uint64).ravel()


def _data(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "replace").lower()


def fingerprint_of(text: str | None, shingle: int = SHINGLE) -> int:
    """The fingerprint of one text; A-Z lower-cased, words between ASCII white space."""
    counts, total = np.zeros(64, np.int64), 0
    for hashes in _shingle_hashes(_data(text), shingle):
        counts += _ones(hashes)
        total += len(hashes)
    return int(_majority(counts, total)[0])


_ORDERS = np.random.default_rng(SEED).integers(1, 1 << 63, BANDS * BAND, np.uint64) * np.uint64(2) + np.uint64(1)


def sketch_of(text: str | None) -> tuple[int, np.ndarray, np.ndarray]:
    """``(size, proof, keys)`` of the set of five-word shingles: how many there are, a
    fingerprint of ``PROOF`` words, and ``BANDS`` keys (of an empty set: all equal).

    A five-word shingle is two three-word ones, two words apart; of a text of fewer than
    five words the set is what shingles it has.
    """
    threes = np.concatenate([np.zeros(0, np.uint64), *_shingle_hashes(_data(text), SHINGLE)])
    fives = mix(threes[:-2] * np.uint64(0x9E3779B97F4A7C15) + threes[2:]) if len(threes) > 2 else threes
    fives = np.unique(fives)
    proof = [_majority(_ones(mix(fives * np.uint64(2 * k + 1) + np.uint64(k))), len(fives)) for k in range(1, PROOF + 1)]
    if not len(fives):
        return 0, np.concatenate(proof), np.zeros(BANDS, np.uint64)
    minima = np.fromiter(((fives * order).min() for order in _ORDERS), np.uint64, len(_ORDERS)).reshape(BANDS, BAND)
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(BAND):
        keys = mix(keys * np.uint64(0xC2B2AE3D27D4EB4F) + minima[:, k])
    return len(fives), np.concatenate(proof), keys


def _shingle_set(text: str | None, shingle: int) -> np.ndarray:
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *_shingle_hashes(_data(text), shingle)]))


def similarity_of(one: Column, other: Column, shingle: int = 5) -> Column:
    """Shared shingles of two texts by all their shingles; 1 when neither has any."""

    def of(left: pa.Array, right: pa.Array) -> pa.Array:
        out, last, held = [], None, None
        for a, b in zip(left, right):
            a = a.as_py()
            if held is None or a != last:  # rows of one centre lie together
                last, held = a, _shingle_set(a, shingle)
            more = _shingle_set(b.as_py(), shingle)
            shared = len(np.intersect1d(held, more, assume_unique=True))
            out.append(shared / max(len(held) + len(more) - shared, 1) if len(held) or len(more) else 1.0)
        return pa.array(out, pa.float64())

    return F.arrow_udf(of, "double")(one, other)


def fingerprint(text: Column, shingle: int = SHINGLE) -> Column:
    """The fingerprint as a signed 64-bit number."""

    def of(texts: pa.Array) -> pa.Array:
        found = np.fromiter((fingerprint_of(t.as_py(), shingle) for t in texts), np.uint64, len(texts))
        return pa.array(found.view(np.int64))

    return F.arrow_udf(of, "long")(text)


def sketch(text: Column) -> Column:
    """``sketch_of`` as a struct of signed numbers."""

    def of(texts: pa.Array) -> pa.Array:
        found = [sketch_of(t.as_py()) for t in texts]
        words = pa.list_(pa.int64())
        return pa.StructArray.from_arrays(
            [
                pa.array([n for n, _, _ in found], pa.int64()),
                pa.array([p.view(np.int64) for _, p, _ in found], words),
                pa.array([k.view(np.int64) for _, _, k in found], words),
            ],
            ["size", "proof", "keys"],
        )

    return F.arrow_udf(of, "struct<size: long, proof: array<long>, keys: array<long>>")(text)


def links(distinct: DataFrame) -> DataFrame:
    """``a, b`` (``a`` < ``b``) of the fingerprints in ``distinct(fp)`` that are linked."""
    first, second = F.shiftrightunsigned("fp", 32), F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
    halves = distinct.select("fp", F.posexplode(F.array(first, second)).alias("segment", "value"))

    def side(rows: DataFrame, name: str, *keys: str) -> DataFrame:
        return rows.select(F.col("fp").alias(name), *keys)

    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= BITS_APART
    equal = side(halves, "a", "segment", "value").join(
        side(halves, "b", "segment", "value"), ["segment", "value"]
    ).where(F.col("a") < F.col("b")).where(near)
    bit = F.expr("shiftleft(1L, wildcard)")
    variants = distinct.select("fp", F.explode(F.sequence(F.lit(0), F.lit(31))).alias("wildcard")).select(
        "fp", "wildcard", (first.bitwiseAND(F.bitwise_not(bit))).alias("rest"), (first.bitwiseAND(bit) != 0).alias("on")
    )
    odd = side(variants.where("not on"), "a", "wildcard", "rest").join(
        side(variants.where("on"), "b", "wildcard", "rest"), ["wildcard", "rest"]
    ).where(near)
    pairs = equal.select("a", "b").unionByName(odd.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
    return pairs


def _most_bits(similarity: float, slack: float = SLACK) -> int:
    """Bits of the proof that texts of this similarity differ in, and a little more."""
    apart = float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)
    n = 64 * PROOF
    return int(n * apart + slack * np.sqrt(n * apart * (1 - apart)))


def _near(one: str, other: str, similarity: float) -> Column:
    """Whether two rows of ``_side`` can be alike, by their sizes and their proofs."""
    size_a, size_b = F.col(f"size_{one}"), F.col(f"size_{other}")
    sizes = F.least(size_a, size_b) >= similarity * F.greatest(size_a, size_b)
    bits = F.lit(0)
    for k in range(PROOF):
        bits = bits + F.bit_count(F.col(f"p{k}_{one}").bitwiseXOR(F.col(f"p{k}_{other}")))
    return sizes & (bits <= _most_bits(similarity))


def _linked(narrow: DataFrame) -> DataFrame:
    """``a, b`` (``a`` < ``b``) of texts whose fingerprints, the first words of their proofs, are
    linked. The smallest text of a fingerprint stands for the others, which meet it. Runs jobs."""
    texts = narrow.select("node", F.col("p0").alias("fp"))
    prints = cut(texts.groupBy("fp").agg(F.min("node").alias("least")), "prints")
    ends = links(prints.select("fp")).join(prints.toDF("a", "one"), "a").join(prints.toDF("b", "other"), "b")
    between = ends.select(F.least("one", "other").alias("a"), F.greatest("one", "other").alias("b"))
    within = texts.join(prints, "fp").where("least < node").select(F.col("least").alias("a"), F.col("node").alias("b"))
    return cut(between.unionByName(within).distinct(), "linked")


def _side(entries: DataFrame, name: str) -> DataFrame:
    """``key`` and the other columns renamed for one side of a join."""
    return entries.select("key", *[F.col(c).alias(name if c == "node" else f"{c}_{name}") for c in entries.columns if c != "key"])


def similar(nodes: DataFrame, texts: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``node, root`` of every row of ``nodes(node, size, proof, keys)``: alike texts have one root.

    ``texts(row, text)`` has the text of each node, by its number; both are written tables.

    Texts whose fingerprints are linked, and texts that share a key, are candidates. First
    each meets the smallest text that its fingerprint is linked to and the smallest of its
    keys, and those alike are joined to components. Then all links of fingerprints between
    different components are tried; and in keys that hold several components, texts of
    different components meet inside a join that lets only likely pairs out: first each
    text with its nearest of every other component, then, once those are joined, all that
    are still apart. Runs jobs.
    """
    narrow = nodes.select("node", "size", "keys", *[F.get("proof", F.lit(k)).alias(f"p{k}") for k in range(PROOF)])

    def entries(rows: DataFrame) -> DataFrame:
        return rows.select(F.explode("keys").alias("key"), *[c for c in rows.columns if c != "keys"])

    keyed = entries(nodes.select("node", "keys"))
    centers = keyed.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a < b").select("key", "a")
    stars = keyed.withColumnRenamed("node", "b").join(centers, "key").where("a < b").select("a", "b").distinct()
    both = cut(stars, "stars").join(narrow.drop("keys").toDF("a", "size_a", *[f"p{k}_a" for k in range(PROOF)]), "a")
    both = both.join(narrow.drop("keys").toDF("b", "size_b", *[f"p{k}_b" for k in range(PROOF)]), "b")
    linked = _linked(narrow)
    smallest = linked.groupBy("b").agg(F.min("a").alias("a"))
    likely = both.where(_near("a", "b", similarity)).select("a", "b").unionByName(smallest.select("a", "b")).distinct()
    judged = cut(_verified(cut(likely, "likely"), texts, similarity), "links")
    rooted = narrow.join(components(judged), "node", "left").withColumn("root", F.coalesce("root", "node"))
    rooted = cut(rooted, "rooted")

    for nearest in (True, False):
        slim = entries(rooted.select("node", "keys", "root"))
        several = slim.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
        # A node takes part when one of its keys holds another component too.
        open_keys = slim.join(several.select("key"), "key", "left_semi").groupBy("node").agg(F.collect_list("key").alias("keys"))
        open_entries = cut(entries(rooted.drop("keys").join(open_keys, "node")), "open")
        pairs = _side(open_entries, "a").join(_side(open_entries, "b"), "key").where(F.col("root_a") < F.col("root_b"))
        pairs = pairs.where(_near("a", "b", similarity))
        if nearest:
            apart = sum((F.bit_count(F.col(f"p{k}_a").bitwiseXOR(F.col(f"p{k}_b"))) for k in range(PROOF)), F.lit(0))
            best = F.min(F.struct(apart.alias("bits"), "a", "b"))
            pairs = pairs.groupBy("a", "root_b").agg(best.alias("p")).select("p.a", "p.b")
            roots = rooted.select("node", "root")
            between = linked.join(roots.toDF("a", "root_a"), "a").join(roots.toDF("b", "root_b"), "b")
            pairs = pairs.unionByName(between.where("root_a <> root_b").select("a", "b"))
        tried = cut(pairs.select("a", "b").distinct().join(judged, ["a", "b"], "left_anti"), "tried")
        if tried.isEmpty():
            continue
        judged = judged.unionByName(tried)
        rooted = cut(_regrouped(rooted, _verified(tried, texts, similarity)), "rooted")
    return rooted.select("node", "root")


def _regrouped(rooted: DataFrame, links: DataFrame) -> DataFrame:
    """``rooted(node, root, ...)`` after the components that ``links(a, b)`` join are one. Runs jobs."""
    roots = rooted.select("node", "root")
    bridges = links.join(roots.toDF("a", "root_a"), "a").join(roots.toDF("b", "root_b"), "b").select("root_a", "root_b")
    joined = components(bridges.toDF("a", "b"), "bridges").toDF("root", "top")
    return rooted.join(joined, "root", "left").withColumn("root", F.coalesce("top", "root")).drop("top")


def _verified(likely: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Those of the pairs ``likely(a, b)``, a written table, whose texts are alike. Runs jobs."""
    needed = likely.select(F.col("a").alias("row")).unionByName(likely.select(F.col("b").alias("row"))).distinct()
    held = cut(texts.join(broadcast_within(cut(needed, "needed"), F.lit(24)), "row"), "texts")
    one, other = held.select(F.col("row").alias("a"), F.col("text").alias("one")), held.select(
        F.col("row").alias("b"), F.col("text").alias("other")
    )
    alike = similarity_of(F.col("one"), F.col("other")) >= similarity
    return likely.join(one, "a").join(other, "b").where(alike).select("a", "b")


def components(edges: DataFrame, name: str = "stars") -> DataFrame:
    """``node, root`` of every node of ``edges(a, b)``, the root the smallest node.

    Rounds of large and small stars, each cut by one table, until every node but a root
    hangs from just one other, a root. Runs jobs.
    """
    edges = cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), name)
    while True:
        ends = edges.select(F.col("b").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
            edges.select(F.col("a").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down"))
        )
        state = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        if state.where("up + down > 1").isEmpty():
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(lowest, "a").where("b > a").select(F.col("m").alias("a"), "b").where("a < b").distinct()
        floor = large.groupBy("b").agg(F.min("a").alias("m"))
        joined = large.join(floor, "b")
        small = joined.select(F.col("m").alias("a"), F.col("a").alias("b")).where("a < b").unionByName(
            joined.select(F.col("m").alias("a"), "b")
        )
        edges = cut(small.distinct(), name)
    roots = edges.select("a").distinct().select(F.col("a").alias("node"), F.col("a").alias("root"))
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(roots)


def fingerprint_classes(prints: DataFrame) -> DataFrame:
    """``fp, component_id, root`` of a written table with ``doc_id`` and ``fp``. Runs jobs."""
    classes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    roots = components(links(classes.select("fp")))
    rooted = classes.join(roots, F.col("fp") == F.col("node"), "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(ids.withColumnRenamed("root", "_root"), F.col("root") == F.col("_root"))
    return cut(named.select("fp", "component_id", "root"), "components")


def with_components(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, fp`` (signed), ``component_id``, one row a document. Runs jobs."""
    prints = cut(docs.select("doc_id", fingerprint(F.col("text"), shingle).alias("fp")), "prints")
    return prints.join(fingerprint_classes(prints).select("fp", "component_id"), "fp")


def one_of_each(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row of every group of near copies, that of its smallest ``doc_id``; all columns stay.

    Near are texts whose five-word shingles have at least ``similarity``. Each different
    text is a node, named by its smallest row number. Rows are numbered in a table written
    to the shared folder, so that of repeated rows just one stays. Runs jobs.
    """
    with rows_per_batch(docs.sparkSession, TEXTS):
        text = F.coalesce(F.col("text"), F.lit(""))
        marked = docs.select(
            F.struct(*docs.columns).alias("doc"), sketch(F.col("text")).alias("sketch"), F.unhex(F.sha2(text, 256)).alias("name")
        )
        table = cut(marked.withColumn("row", F.monotonically_increasing_id()), "rows")
        prints = table.select(F.col("doc.doc_id").alias("doc_id"), "sketch", "name", "row")
        grouped = prints.groupBy("name").agg(
            F.min("row").alias("node"), F.min("sketch").alias("sketch"),
            F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("first"),
        )
        nodes = cut(grouped.select("node", "first", "sketch.*"), "nodes")
        roots = similar(nodes, table.select("row", F.col("doc.text").alias("text")), similarity)
    rooted = nodes.select("node", "first").join(roots, "node")
    kept = rooted.groupBy("root").agg(F.min("first").alias("first"))
    gone = cut(prints.select("row").join(kept.select("first.row"), "row", "left_anti"), "gone")
    return table.join(broadcast_within(gone, F.lit(24)), "row", "left_anti").select("doc.*")


def hexadecimal(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
