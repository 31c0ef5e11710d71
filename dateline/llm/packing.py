"""Documents into as few token sequences as possible, by linear grouping.

1. Texts become ids in tasks; a document longer than a sequence is cut into full
   pieces, the first of which may be shorter. Only lengths and checksums travel on.
2. The histogram of piece lengths (one number a length) gives the plan: large lengths
   are grouped with equal cardinality and rounded up to their group's largest, and a
   linear program over configurations of these few sizes is solved by column
   generation.
3. Pieces are dealt into groups of about ``GROUP`` by a hash of their row, so a group
   looks like the whole. In each, every configuration is filled with actual pieces:
   whole uses first, then the fractional ones while large pieces wait. A slot may take
   a longer piece than its size where the others leave room. Large pieces left over go
   where they fit best, and then the small ones.

Pieces as long as a sequence stand alone. Null and empty texts are the end id alone.
Repeated rows are packed like any other; a row is known by its place in a written table.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Callable
from functools import cache

import numpy as np
import pyarrow as pa
import pyspark.sql.types as T
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dateline.llm.batches import TEXTS, rows_per_batch
from dateline.session import cut

CAPACITY = 2048
END_ID = 0
SMALL = CAPACITY // 8
CLASSES = 96
GROUP = 16_384
SPECIAL = "<|endoftext|>"

_held: dict[str, Callable] = {}


@cache
def _whole(tokenizer: str) -> object:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer)


def encoder(tokenizer: str, ranks: str | None = None) -> Callable[[str], list[int]]:
    """Texts to ids by the tokenizer file; loaded once in a process.

    ``ranks``, the same vocabulary as ranks, gives the same ids several times faster.
    Texts that spell a special token always go to the tokenizer itself, which is only then
    loaded.
    """
    key = f"{tokenizer} {ranks}"
    if key not in _held:
        own = lambda text: _whole(tokenizer).encode(text, add_special_tokens=False).ids
        if ranks:
            import tiktoken

            with open(ranks, "rb") as file:
                table = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file)}
            pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
            quick = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})
            _held[key] = lambda text: own(text) if SPECIAL in text else quick.encode_ordinary(text)
        else:
            _held[key] = own
    return _held[key]


_PIECE = pa.struct([("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int32()), ("ids_crc32", pa.int64())])
_PIECES = "array<struct<piece: int, start: long, length: int, ids_crc32: long>>"


def pieces(text: Column, tokenizer: str, ranks: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> Column:
    """Pieces of the text's ids and the end id: number, ids before it, length, checksum."""

    def cut_up(texts: pa.Array) -> pa.Array:
        encode, out = encoder(tokenizer, ranks), []
        for text in texts:
            ids = np.array([*encode(text.as_py() or ""), end_id], "<u4")
            head = len(ids) % capacity or capacity
            bounds = [0, *range(head, len(ids) + 1, capacity)]
            out.append(
                [
                    {"piece": k, "start": a, "length": b - a, "ids_crc32": zlib.crc32(ids[a:b].tobytes())}
                    for k, (a, b) in enumerate(zip(bounds, bounds[1:]))
                ]
            )
        return pa.array(out, pa.list_(_PIECE))

    return F.arrow_udf(cut_up, _PIECES)(text)


def _knapsack(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable configuration: how often each size is used."""
    best = np.zeros(capacity + 1)
    choices = []
    for size, value in zip(sizes, worth):
        taken = np.zeros(capacity + 1, np.int16)
        base = best.copy()
        for count in range(1, capacity // size + 1):
            gain = base[: capacity + 1 - count * size] + count * value
            better = gain > best[count * size :] + 1e-12
            best[count * size :][better] = gain[better]
            taken[count * size :][better] = count
        choices.append(taken)
    left, used = int(capacity), np.zeros(len(sizes), np.int64)
    for k in range(len(sizes) - 1, -1, -1):
        used[k] = choices[k][left]
        left -= used[k] * sizes[k]
    return float(best[capacity]), used


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Column generation: ``(configurations, how often each)`` covering the demand with
    fractionally few sequences. Bounded by the number of sizes, whatever the demand."""
    k = len(sizes)
    basis = np.diag((capacity // sizes).astype(float))
    amount = demand / np.diag(basis)
    for _ in range(60 * k):
        prices = np.linalg.solve(basis.T, np.ones(k))
        worth, column = _knapsack(sizes, np.maximum(prices, 0), capacity)
        if worth <= 1 + 1e-7:
            break
        way = np.linalg.solve(basis, column.astype(float))
        steps = np.where(way > 1e-9, amount / np.where(way > 1e-9, way, 1), np.inf)
        out = int(np.argmin(steps))
        amount = np.maximum(amount - steps[out] * way, 0)
        amount[out] = steps[out]
        basis[:, out] = column
    return basis.T.astype(np.int64), amount


def plan(histogram: np.ndarray, capacity: int, small: int, classes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(bounds, configurations, amounts)`` from the number of pieces of each length.

    ``bounds`` are the sizes lengths above ``small`` round up to.
    """
    large = histogram.astype(float).copy()
    large[: small + 1] = 0
    total = large.sum()
    if not total:
        return np.zeros(0, np.int64), np.zeros((0, 0), np.int64), np.zeros(0)
    ranks = np.cumsum(large)
    marks = total * np.arange(1, classes + 1) / classes
    bounds = np.unique(np.searchsorted(ranks, marks - 1e-6 * total).clip(small + 1, capacity))
    last = int(np.flatnonzero(large)[-1])
    bounds = np.unique(np.append(bounds[bounds < last], last))
    demand = np.diff(np.concatenate([[0], ranks[bounds]]))
    bounds, demand = bounds[demand > 0], demand[demand > 0]
    found, amounts = configurations(bounds, demand, capacity)
    return bounds, found, amounts


class _Bins:
    """Open sequences by room left; the tightest that fits is found through one bit set."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.used, self.room, self.mask = capacity, [], [[] for _ in range(capacity + 1)], 0

    def put_back(self, number: int) -> None:
        left = self.capacity - self.used[number]
        self.room[left].append(number)
        self.mask |= 1 << left

    def open(self) -> int:
        self.used.append(0)
        return len(self.used) - 1

    def best(self, length: int) -> int:
        fits = self.mask >> length
        if not fits:
            return self.open()
        left = length + (fits & -fits).bit_length() - 1
        number = self.room[left].pop()
        if not self.room[left]:
            self.mask &= ~(1 << left)
        return number


def pack_group(
    lengths: np.ndarray, bounds: np.ndarray, found: np.ndarray, share: np.ndarray, capacity: int, small: int
) -> tuple[np.ndarray, np.ndarray]:
    """``(sequence, offset)`` of every piece; ``share`` is this group's part of each configuration.

    Configurations are filled in three orders (loosest, most used, largest size first), and
    the fewest sequences win; in each every large piece comes through a configuration.
    """
    if not len(bounds):
        return _pack(lengths, [], capacity, small)[:2]
    slots = [np.repeat(bounds[::-1], row[::-1]).tolist() for row in found]
    largest = np.array([max(row, default=0) for row in slots])
    orders = [np.argsort(key, kind="stable") for key in (found @ bounds, -share, -largest)]
    whole = np.floor(share + 1e-9)
    part = [j for j in np.argsort(whole - share, kind="stable") if share[j] - whole[j] > 1e-6]
    tried = (
        _pack(lengths, [slots[j] for j in [*np.repeat(order, whole[order].astype(int)), *part]], capacity, small)
        for order in orders
    )
    return min(tried, key=lambda packed: packed[0].max(initial=-1))[:2]


class _Waiting:
    """Large pieces by length; the longest within a room is found through one bit set."""

    def __init__(self, lengths: np.ndarray, small: int, capacity: int) -> None:
        self.of, self.mask = [[] for _ in range(capacity + 1)], 0
        for item in np.flatnonzero(lengths > small)[::-1].tolist():
            self.of[lengths[item]].append(item)
            self.mask |= 1 << int(lengths[item])

    def longest(self, room: int) -> int | None:
        fits = self.mask & ((2 << room) - 1)
        if not fits:
            return None
        length = fits.bit_length() - 1
        item = self.of[length].pop()
        if not self.of[length]:
            self.mask &= ~(1 << length)
        return item


def _pack(
    lengths: np.ndarray, planned: list[list[int]], capacity: int, small: int
) -> tuple[np.ndarray, np.ndarray, int]:
    """``(sequence, offset, large pieces placed by configurations)``.

    ``planned`` are the sequences' slots, largest first. A slot takes the longest piece that
    leaves the later slots their room, so what rounding gave away is used again; what room is
    left after the last slot takes large pieces while any fits.
    """
    sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    bins, waiting, through = _Bins(capacity), _Waiting(lengths, small, capacity), 0

    def place(item: int, number: int) -> None:
        sequence[item], offset[item] = number, bins.used[number]
        bins.used[number] += int(lengths[item])

    for slots in planned:
        if not waiting.mask:
            break
        room, later, picked = capacity, sum(slots), []
        for size in slots:
            later -= size
            item = waiting.longest(room - later)
            if item is not None:
                picked.append(item)
                room -= int(lengths[item])
        while (item := waiting.longest(room)) is not None:
            picked.append(item)
            room -= int(lengths[item])
        number = bins.open()
        for item in picked:
            place(item, number)
        bins.put_back(number)
        through += len(picked)
    order = np.argsort(-lengths, kind="stable")
    rest = sorted((i for held in waiting.of for i in held), key=lambda i: -lengths[i])
    for item in [*rest, *order[lengths[order] <= small].tolist()]:
        number = bins.best(int(lengths[item]))
        place(item, number)
        bins.put_back(number)
    return sequence, offset, through


def pack(
    docs: DataFrame, tokenizer: str, ranks: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID,
    small: int = SMALL, classes: int = CLASSES, group: int = GROUP,
) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset``, one row a piece.

    Runs jobs: the pieces are written to the shared folder and their histogram, at most
    ``capacity`` numbers, comes to the driver.
    """
    rows = docs.select("doc_id", pieces(F.col("text"), tokenizer, ranks, capacity, end_id).alias("p"))
    flat = rows.select("doc_id", F.inline_outer("p")).where("piece is not null")
    with rows_per_batch(docs.sparkSession, TEXTS):
        table = cut(flat.withColumn("row", F.monotonically_increasing_id()), "pieces")
    counts = table.where(F.col("length") < capacity).groupBy("length").agg(F.count("*").alias("n")).toArrow()
    histogram = np.zeros(capacity + 1, np.int64)
    histogram[counts.column("length").to_numpy()] = counts.column("n").to_numpy()
    bounds, found, amounts = plan(histogram, capacity, small, classes)
    groups = max(1, -(-int(histogram.sum()) // group))
    share = amounts / groups

    def pack_one(rows: pa.Table) -> pa.Table:
        number, offset = pack_group(rows.column("length").to_numpy(), bounds, found, share, capacity, small)
        base = rows.column("group").to_numpy() << 32
        return pa.table(
            {
                **{c: rows.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")},
                "sequence_id": pa.array(base + number), "offset": pa.array(offset),
            }
        )

    dealt = table.where(F.col("length") < capacity).withColumn(
        "group", F.pmod(F.xxhash64("row"), F.lit(groups)).cast("long")
    )
    kinds = {f.name: f for f in table.schema}
    schema = T.StructType(
        [*(kinds[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")),
         T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]
    )
    mixed = dealt.groupBy("group").applyInArrow(pack_one, schema)
    alone = table.where(F.col("length") == capacity).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (-1 - F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    return mixed.unionByName(alone).withColumn("length", F.col("length").cast("long"))
