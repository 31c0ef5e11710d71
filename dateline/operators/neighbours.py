"""Exact k nearest neighbours by cosine distance, without all pairs.

1. Equal vectors collapse to one representative with its few smallest ids.
2. Representatives go to the nearest of a bounded set of pivots: the cells.
3. Each looks for neighbours in its own cell. Cells are cut into blocks and every task
   compares one block of queries with one block of the cell, so a hot cell is many
   equal tasks; a task returns k rows per query, never its pairs.
4. The k-th distance found bounds the search: by the triangle inequality a cell farther
   off than that (less its radius) cannot hold a nearer vector. The other cells are
   searched the same way, which makes the result exact. Neighbouring cells share a block,
   so a query is sent once to a block, with its bound and the cells of it that it asks for;
   only what lies within the bound is ordered.

Blocks grow with the table, a quarter of it and one more cell, until they reach
``BLOCK_BYTES``: up to there a vector is sent a bounded number of times, and beyond a task's
memory stays bounded. Vectors of floats are sent as floats with their length; the doubles of
length one that are compared come from these, the same to the last bit.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dateline.functions.vectors import norm
from dateline.operators.ranking import first_per_group
from dateline.session import cut

BLOCK = 4096
BLOCK_BYTES = 48 << 20  # vectors of a block that grows with the table
BLOCKS = 4  # blocks of a table until they reach that
PART = 1024  # queries of a task looked up at a time
PAIRS = 1 << 21  # distances of a task held at a time
PIVOT_BYTES = 64 << 20
_DIGITS = 9
_SLACK = 1e-7
_TIE = 2e-9  # distances this close may be equal when rounded


def _matrix(vectors: pa.Array) -> np.ndarray:
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(vectors), -1) if len(vectors) else np.zeros((0, 0))


def _units(vectors: pa.Array, sizes: pa.Array) -> np.ndarray:
    """Vectors over their lengths, in doubles."""
    return _matrix(vectors).astype(np.float64) / sizes.to_numpy(zero_copy_only=False)[:, None]


def _units_of(rows: pa.Table) -> np.ndarray:
    return _units(rows.column("x").combine_chunks(), rows.column("size").combine_chunks())


def _unit() -> Column:
    return F.transform("x", lambda v: v.cast("double") / F.col("size"))


def _pivots(base: DataFrame, count: int) -> np.ndarray:
    """A bounded sample of vectors, the same whatever the partitioning."""
    return _units_of(base.select("x", "size").orderBy(F.xxhash64("rep"), "rep").limit(count).toArrow())


def _gaps(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (vectors @ pivots.T)))


def _nearest_pivot(pivots: np.ndarray):
    shared = _broadcast(pivots)

    @F.arrow_udf("struct<cell int, gap double>")
    def assign(vectors: pa.Array, sizes: pa.Array) -> pa.Array:
        cells, gaps = [], []
        for start in range(0, len(vectors), 1024):
            gap = _gaps(_units(vectors.slice(start, 1024), sizes.slice(start, 1024)), shared.value)
            best = gap.argmin(axis=1)
            cells.append(best)
            gaps.append(gap[np.arange(len(best)), best])
        cell = np.concatenate(cells) if cells else np.zeros(0)
        gap = np.concatenate(gaps) if gaps else np.zeros(0)
        return pa.StructArray.from_arrays(
            [pa.array(cell.astype(np.int32)), pa.array(gap.astype(np.float64))], names=["cell", "gap"]
        )

    return assign


def _open_cells(pivots: np.ndarray, radius: np.ndarray, chunk: np.ndarray):
    """Cells besides its own that may hold something nearer than a query's bound, by chunk."""
    shared = _broadcast((pivots, radius, chunk))

    @F.arrow_udf("array<struct<chunk int, asks array<int>>>")
    def cells(vectors: pa.Array, sizes: pa.Array, own: pa.Array, bound: pa.Array) -> pa.Array:
        pivots, radius, chunk = shared.value
        parts = [pa.array([], pa.list_(pa.struct([("chunk", pa.int32()), ("asks", pa.list_(pa.int32()))])))]
        for start in range(0, len(vectors), 1024):
            gap = _gaps(_units(vectors.slice(start, 1024), sizes.slice(start, 1024)), pivots)
            limit = bound.slice(start, 1024).to_numpy(zero_copy_only=False)
            keep = gap - radius <= limit[:, None] + _SLACK
            keep[np.arange(len(gap)), own.slice(start, 1024).to_numpy(zero_copy_only=False)] = False
            keep &= radius >= 0
            row, cell = keep.nonzero()  # by row, then cell; chunks are runs of cells
            first = np.flatnonzero(np.diff(row, prepend=-1) | np.diff(chunk[cell], prepend=-1))
            asks = pa.ListArray.from_arrays(
                pa.array(np.append(first, len(cell)).astype(np.int32)), pa.array(cell.astype(np.int32))
            )
            groups = pa.StructArray.from_arrays([pa.array(chunk[cell[first]].astype(np.int32)), asks], ["chunk", "asks"])
            ends = np.searchsorted(row[first], np.arange(len(gap) + 1))
            parts.append(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), groups))
        return pa.concat_arrays(parts)

    return cells


def _chunks(sizes: np.ndarray, block: int) -> np.ndarray:
    """The chunk of each cell: runs of cells of ``block`` vectors at most, or one larger cell."""
    chunk, at, held = np.zeros(len(sizes), np.int64), 0, 0
    for cell, n in enumerate(sizes):
        if held and held + n > block:
            at, held = at + 1, 0
        chunk[cell] = at
        held += n
    return chunk


def _broadcast(value: object) -> Broadcast:
    return SparkSession.active().sparkContext.broadcast(value)


def _first(found: list[tuple[np.ndarray, ...]], k: int, bound: np.ndarray) -> tuple[np.ndarray, ...]:
    """The ``k`` smallest keys of each query in order; the last of ``k`` tightens its bound."""
    who, key, distance = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((key, who))
    who, key, distance = who[order], key[order], distance[order]
    at = np.arange(len(who)) - np.searchsorted(who, who)
    last = at == k - 1
    bound[who[last]] = np.minimum(bound[who[last]], distance[last] + _TIE)
    return who[at < k], key[at < k], distance[at < k]


def _nearest_in_block(k: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        is_query = table.column("is_query").to_numpy()
        base = table.filter(pa.array(~is_query)).sort_by("rep")
        queries = table.filter(pa.array(is_query))
        del table
        if not len(base) or not len(queries):
            return
        names = base.column("rep").combine_chunks()
        n = len(base)
        place = np.argsort(base.column("cell").to_numpy(), kind="stable")  # cell by cell, by id within
        cells, begins = np.unique(base.column("cell").to_numpy()[place], return_index=True)
        span = dict(zip(cells.tolist(), zip(begins.tolist(), [*begins[1:].tolist(), n])))
        u = _matrix(base.column("x").combine_chunks())[place].astype(np.float64)
        u /= base.column("size").to_numpy()[place, None]
        del base

        def key_of(distance: np.ndarray, place: np.ndarray) -> np.ndarray:
            # One integer orders by distance, then by id (the place among all, sorted by id).
            return np.rint(np.maximum(distance, 0.0) * 10**_DIGITS).astype(np.int64) * n + place

        for start in range(0, len(queries), PART):
            part = queries.slice(start, PART)
            q = _units_of(part)
            bound = part.column("bound").to_numpy() + _TIE
            asks = part.column("asks").combine_chunks()
            asking = np.repeat(np.arange(len(q)), asks.value_lengths().to_numpy())
            asked = asks.flatten().to_numpy()
            found, held = [], 0
            for c in np.unique(asked).tolist():
                if c not in span:
                    continue
                who = asking[asked == c]
                mine, step = q[who], max(1, PAIRS // len(who))
                for low in range(*span[c], step):
                    high = min(low + step, span[c][1])
                    distance = 1.0 - mine @ u[low:high].T
                    near = distance <= bound[who, None]
                    many = np.count_nonzero(near) > 2 * k * len(who)
                    if many:  # no bound yet, or ties
                        key = key_of(distance, place[low:high])
                        take = min(k, high - low)
                        at = np.argpartition(key, take - 1, axis=1)[:, :take]
                        mark = np.repeat(who, take), *(np.take_along_axis(x, at, axis=1).ravel() for x in (key, distance))
                    else:
                        row, col = near.nonzero()
                        mark = who[row], key_of(distance[row, col], place[low + col]), distance[row, col]
                    found.append(mark)
                    held += len(mark[0])
                    if many or held > 4 * k * len(q):
                        found = [_first(found, k, bound)]
                        held = len(found[0][0])
            if not held:
                continue
            who, key, distance = _first(found, k, bound)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("rep").combine_chunks().take(pa.array(who)),
                    names.take(pa.array(key % n)),
                    pa.array(distance),
                ],
                names=["rep", "near", "distance"],
            )

    return search


def _probe(queries: DataFrame, base: DataFrame, sizes: DataFrame, k: int, block: int) -> DataFrame:
    """Nearest ``k`` of each query within the cells it asks for, block by block.

    ``queries(rep, x, size, chunk, asks, bound)``, ``base(rep, x, size, chunk, cell)``;
    ``sizes(chunk, n)`` has at most one row per pivot, which bounds the broadcast.
    """
    asked = queries.groupBy("chunk").agg(F.count("*").alias("asked"))
    blocks = asked.join(F.broadcast(sizes), "chunk").select(
        "chunk",
        F.ceil(F.col("asked") / block).cast("int").alias("q_blocks"),
        F.ceil(F.col("n") / block).cast("int").alias("b_blocks"),
    )
    blocks = cut(blocks, "blocks")

    def block_key(n: str, seed: int) -> Column:
        return F.pmod(F.xxhash64("rep", F.lit(seed)), F.col(n)).cast("int")

    def every(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    asking = (
        queries.join(F.broadcast(blocks), "chunk")
        .withColumn("qb", block_key("q_blocks", 1))
        .withColumn("bb", every("b_blocks"))
        .select(
            "chunk", "qb", "bb", "rep", "x", "size", F.lit(-1).alias("cell"), "asks", "bound", F.lit(True).alias("is_query")
        )
    )
    asked_of = (
        base.join(F.broadcast(blocks), "chunk")
        .withColumn("bb", block_key("b_blocks", 2))
        .withColumn("qb", every("q_blocks"))
        .select(
            "chunk", "qb", "bb", "rep", "x", "size", "cell", F.lit(None).cast("array<int>").alias("asks"),
            F.lit(None).cast("double").alias("bound"), F.lit(False).alias("is_query"),
        )
    )
    kind = dict(base.dtypes)["rep"]
    return (
        asking.unionByName(asked_of)
        .groupBy("chunk", "qb", "bb")
        .applyInArrow(_nearest_in_block(k), f"rep {kind}, near {kind}, distance double")
    )


def _by_distance() -> list[Column]:
    return [F.round("distance", _DIGITS), F.col("near")]


def neighbours(
    vectors: DataFrame,
    k: int = 5,
    ident: str = "id",
    vector: str = "vector",
    block: int | None = None,
    pivots: int | None = None,
) -> DataFrame:
    """``(id, rank, neighbour, distance)``; the point itself is its first neighbour.

    ``block`` is how many vectors a task compares with as many queries; by default it
    grows with the table, from ``BLOCK`` to ``BLOCK_BYTES``. Ties go to the smaller id. Zero
    vectors and those with a component that is no finite number have no direction and are left
    out. Runs several jobs; intermediate tables go to the shared folder.
    """
    spark = vectors.sparkSession
    floats = dict(vectors.dtypes)[vector] == "array<float>"
    x = F.col(vector).cast("array<float>" if floats else "array<double>")
    units = cut(
        vectors.select(F.col(ident).alias("id"), x.alias("x"), F.explode_outer(F.array(norm(x))).alias("size"))
        .where((F.col("size") > 0) & F.forall("x", lambda v: F.abs(v) < math.inf)),
        "units",
    )
    reps = (
        units.select("id", "size", _unit().alias("u")).groupBy("u")
        .agg(F.min("id").alias("rep"), F.min("size").alias("size"))
    )
    if floats:  # what had this length, again: the quotient times the length is off by less than a float tells apart
        reps = reps.select("rep", F.transform("u", lambda v: (v * F.col("size")).cast("float")).alias("x"), "size")
    else:
        reps = reps.select("rep", F.col("u").alias("x"), F.lit(1.0).alias("size"))
    base = cut(reps, "distinct")
    total = base.count()
    kind = dict(units.dtypes)["id"]
    if total == 0:
        return base.select(
            F.col("rep").alias("id"), F.lit(1).alias("rank"), F.col("rep").alias("neighbour"),
            F.lit(0.0).alias("distance"),
        )
    if units.count() == total:  # no copies
        members = base.select(F.col("rep").alias("id"), "rep")
    else:
        copied = units.select("id", _unit().alias("u")).join(base.select("rep", _unit().alias("u")), "u")
        members = cut(copied.select("id", "rep"), "members")
    width = base.select(F.size("x")).first()[0]
    if pivots is None:
        pivots = 1 if total <= (block or BLOCK) else math.ceil(math.sqrt(total))
    if block is None:
        share = math.ceil(total / BLOCKS) + math.ceil(total / pivots)  # runs of whole cells fill it to one cell
        block = max(BLOCK, min(share, BLOCK_BYTES // ((4 if floats else 8) * width)))
    centers = _pivots(base, max(1, min(pivots, PIVOT_BYTES // (8 * width))))
    placed = cut(
        base.withColumn("p", _nearest_pivot(centers)(F.col("x"), F.col("size")))
        .select("rep", "x", "size", "p.cell", "p.gap"),
        "cells",
    )
    sizes = cut(placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("gap").alias("radius")), "sizes")
    alone = placed.select("rep", "x", "size", "cell", F.col("cell").alias("chunk"))
    asking = alone.withColumn("asks", F.array("cell")).withColumn("bound", F.lit(math.inf))
    own = first_per_group(
        _probe(asking, alone, sizes.withColumnRenamed("cell", "chunk"), k, block),
        ["rep"],
        _by_distance(),
        k,
    )
    found = own
    if len(centers) > 1:
        own = cut(own, "own-cell")
        radius, counts = np.full(len(centers), -1.0), np.zeros(len(centers), np.int64)
        for row in sizes.collect():  # one row per pivot
            radius[row["cell"]], counts[row["cell"]] = row["radius"], row["n"]
        chunk = _chunks(counts, block)
        named = spark.createDataFrame([(c, int(at)) for c, at in enumerate(chunk)], "cell int, chunk int")
        last = own.groupBy("rep").agg(F.count("*").alias("n"), F.max("distance").alias("d"))
        last = last.select("rep", F.when(F.col("n") >= k, F.col("d")).otherwise(math.inf).alias("bound"))
        limit = F.sqrt(F.greatest(F.lit(0.0), 2 * F.col("bound")))
        open_cells = _open_cells(centers, radius, chunk)
        opened = open_cells(F.col("x"), F.col("size"), F.col("cell"), limit).alias("open")
        queries = placed.join(last, "rep").select("rep", "x", "size", "bound", opened)
        queries = queries.select("rep", "x", "size", "bound", F.inline_outer("open")).where("chunk is not null")
        queries = cut(queries, "queries")
        together = placed.select("rep", "x", "size", "cell").join(F.broadcast(named), "cell")
        held = sizes.join(F.broadcast(named), "cell").groupBy("chunk").agg(F.sum("n").alias("n"))
        more = _probe(queries, together, held, k, block)
        found = first_per_group(own.unionByName(more), ["rep"], _by_distance(), k)
    copies = first_per_group(members, ["rep"], [F.col("id")], k)
    entries = (
        found.join(copies.select(F.col("rep").alias("near"), "id"), "near")
        .select("rep", F.col("id").alias("near"), "distance")
    )
    nearest = first_per_group(entries, ["rep"], _by_distance(), k, rank="rank")
    lists = nearest.groupBy("rep").agg(
        F.sort_array(F.collect_list(F.struct("rank", "near", "distance"))).alias("near")
    )
    others = F.slice(F.filter("near", lambda e: e["near"] != F.col("id")), 1, k - 1)
    itself = F.array(F.struct(F.lit(1).alias("rank"), F.col("id").alias("near"), F.lit(0.0).alias("distance")))
    ranked = members.join(lists, "rep").select(
        "id", F.posexplode(F.concat(itself, others)).alias("at", "e")
    )
    return ranked.select(
        "id",
        (F.col("at") + 1).alias("rank"),
        F.col("e.near").cast(kind).alias("neighbour"),
        F.greatest(F.lit(0.0), F.col("e.distance")).alias("distance"),
    )
