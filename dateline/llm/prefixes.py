"""Shared beginnings of conversations, as the nodes of a prefix trie.

A conversation is a path of turns; all conversations with the same first ``d`` turns pass
through one node of depth ``d``. Knowing the nodes tells what a cache of prefixes saves.

A turn is named by 16 bytes of a SHA-256 of its role and text, and a prefix by 16 bytes of
the SHA-256 chained over its turns, so texts never travel. Every task builds a z-fast trie of
its conversations (``ZFastTrie``): only branching and ending nodes are kept, each in a hash
table under its handle, the prefix whose length is the two-fattest number on the node's
edge. A conversation's exit node is found by fat binary search over its prefix names, in a
logarithm of its length of lookups. Conversations go in by batches: all are located first,
then every edge is cut at all its exits at once. At the end edges are expanded into one row
per depth, and rows of equal prefix from all tasks are added up by Spark.

What needs other tasks' nodes is additive too: a node belongs to the smallest of its members,
so one more pass, told from which depth on each conversation owns its nodes, adds up what is
distinct in a subtree. No task gathers the members of a node; ids that end at one node are
joined in blocks of ``BLOCK`` ids and hashed as a stream.

Turns are in the order of ``turn``, null first; equal ones in the order of their turn's
name. Null roles and texts are empty. Rows without ``conv_id`` belong to no conversation and are
left out; an empty table has no nodes. Other columns are not read. A task's memory follows
``HELD`` turns and its longest conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dateline.session import cut

GROUP = 100  # conversations that may share a beginning with the first of them
SHARED = 6  # the beginning taken over is shorter than this
BATCH = 512  # conversations located before any of them is inserted
HELD = 250_000  # turns a task's trie holds before it is expanded and begun anew
BLOCK_BITS = 12  # ids joined to one text at a time are at most 2^this
NAME = 16
ROOT = hashlib.sha256(b"root").digest()[:NAME]
NEVER = 1 << 40  # a depth that no conversation reaches


def two_fattest(low: int, high: int) -> int:
    """The number in ``(low, high]`` that the largest power of two divides."""
    return high & (-1 << ((low ^ high).bit_length() - 1))


class Path:
    """One or more equal conversations: names of all prefixes, sizes of all turns, who ends there."""

    __slots__ = ("names", "chars", "ends")

    def __init__(self, names: list[bytes], chars: list[int]):
        self.names, self.chars, self.ends = names, chars, []


class Node:
    """A branching or ending node; its edge reaches from ``parent.depth`` to ``depth`` on ``path``."""

    __slots__ = ("parent", "depth", "path", "ends")

    def __init__(self, parent: Node | None, depth: int, path: Path):
        self.parent, self.depth, self.path, self.ends = parent, depth, path, []


class ZFastTrie:
    """A compacted trie over prefix names."""

    def __init__(self) -> None:
        self.root = Node(None, 0, Path([ROOT], [0]))
        self.nodes = [self.root]
        self.handles: dict[bytes, Node] = {}
        self.below: dict[bytes, Node] = {}  # the node of the edge that begins with this prefix
        self.held = 0

    def exit(self, path: Path) -> tuple[Node, Node | None, int]:
        """``(deepest node on the path, node of the edge it leaves on or None, depth of leaving)``."""
        names, last = path.names, len(path.names) - 1
        node, high = self.root, last
        leaving = None
        while node.depth < high:
            at = two_fattest(node.depth, high)
            found = self.handles.get(names[at])
            if found is None:
                high = at - 1
            elif found.depth <= last and found.path.names[found.depth] == names[found.depth]:
                node = found
            else:
                leaving = found
                break
        # The search may pass nodes by from above, never from below.
        if leaving is None and node.depth < last:
            leaving = self.below.get(names[node.depth + 1])
        if leaving is None:
            return node, None, node.depth
        parent = leaving.parent
        shared, most = parent.depth + 1, min(leaving.depth, last)
        while shared < most:
            middle = (shared + most + 1) // 2
            if leaving.path.names[middle] == names[middle]:
                shared = middle
            else:
                most = middle - 1
        return parent, leaving, shared

    def _attach(self, node: Node) -> None:
        low, names = node.parent.depth, node.path.names
        self.handles[names[two_fattest(low, node.depth)]] = node
        self.below[names[low + 1]] = node

    def insert(self, batch: Iterable[Path]) -> None:
        """Insert many paths: located together, edges cut at all exits, until none is left."""
        waiting: dict[bytes, Path] = {}
        for path in batch:
            first = waiting.setdefault(path.names[-1], path)
            if first is not path:
                first.ends += path.ends
        left = list(waiting.values())
        while left:
            cuts: dict[int, tuple[Node, set[int]]] = {}
            fresh: dict[bytes, tuple[Path, int, Node, Node | None]] = {}
            again = []
            for path in left:
                node, leaving, depth = self.exit(path)
                if depth == len(path.names) - 1 and leaving is None:
                    node.ends += path.ends
                    continue
                if leaving is not None:
                    cuts.setdefault(id(leaving), (leaving, set()))[1].add(depth)
                # A path that ends inside the edge, or the first to leave here this way.
                way = path.names[min(depth + 1, len(path.names) - 1)]
                if way in fresh:
                    again.append(path)
                else:
                    fresh[way] = path, depth, node, leaving
            made = {k: self._split(edge, sorted(depths)) for k, (edge, depths) in cuts.items()}
            for path, depth, node, leaving in fresh.values():
                at = node if leaving is None else made[id(leaving)][depth]
                if depth < len(path.names) - 1:
                    at = Node(at, len(path.names) - 1, path)
                    self.nodes.append(at)
                    self._attach(at)
                    self.held += len(path.names)
                at.ends += path.ends
            left = again

    def _split(self, edge: Node, depths: list[int]) -> dict[int, Node]:
        """Put nodes on an edge at the given depths, all above its end."""
        del self.handles[edge.path.names[two_fattest(edge.parent.depth, edge.depth)]]
        made, above = {}, edge.parent
        for depth in depths:
            above = made[depth] = Node(above, depth, edge.path)
            self.nodes.append(above)
            self._attach(above)
        edge.parent = above
        self._attach(edge)
        return made

    def sums(self, value: dict[int, list]) -> None:
        """Add every node's list, by ``id(node)``, to its parent's; the first item is a minimum."""
        for node in sorted(self.nodes, key=lambda n: -n.depth):
            if node.parent is not None:
                mine, up = value[id(node)], value[id(node.parent)]
                up[0] = min(up[0], mine[0])
                for k in range(1, len(mine)):
                    up[k] += mine[k]


def members(trie: ZFastTrie) -> Iterator[dict]:
    """One row per depth of every edge: the prefix, its parent, its members' number and smallest."""
    value = {id(n): [min(n.ends, default=1 << 63), len(n.ends)] for n in trie.nodes}
    trie.sums(value)
    for node in trie.nodes:
        first, n = value[id(node)]
        names, top = node.path.names, node.parent.depth + 1 if node.parent else 0
        for depth in range(top, node.depth + 1):
            yield {
                "node": names[depth], "parent": names[depth - 1] if depth else None, "depth": depth,
                "chars": node.path.chars[depth], "first": first, "n": n,
                "ends": node.ends if depth == node.depth else [],
            }


def totals(trie: ZFastTrie, owned_from: dict[int, int], leaf: dict[int, int]) -> Iterator[dict]:
    """One row per depth of every edge: leaves below it, code points of all members' turns
    from it on (each member's counted), and those of the distinct nodes this task owns."""
    lists = {id(n): [min(n.ends, default=1 << 63), len(n.ends), sum(leaf.get(c, 0) for c in n.ends)] for n in trie.nodes}
    trie.sums(lists)
    spent, own = {id(n): 0 for n in trie.nodes}, {id(n): 0 for n in trie.nodes}
    for node in sorted(trie.nodes, key=lambda n: -n.depth):
        first, n, leaves = lists[id(node)]
        begins, all_turns, distinct = owned_from.get(first, NEVER), spent[id(node)], own[id(node)]
        top = node.parent.depth + 1 if node.parent else 0
        for depth in range(node.depth, top - 1, -1):
            chars = node.path.chars[depth]
            all_turns += n * chars
            distinct += chars if depth >= begins else 0
            yield {"node": node.path.names[depth], "leaves": leaves, "spent": all_turns, "own": distinct}
        if node.parent is not None:
            spent[id(node.parent)] += all_turns
            own[id(node.parent)] += distinct


_MEMBERS = "node binary, parent binary, depth long, chars long, first long, n long, ends array<long>"
_TOTALS = "node binary, leaves long, spent long, own long"


def _paths(row: dict) -> Path:
    names = [ROOT]
    for key in row["keys"][1:]:
        names.append(hashlib.sha256(names[-1] + key).digest()[:NAME])
    path = Path(names, row["chars"])
    path.ends.append(row["conv_id"])
    return path


def _rows(rows: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == 20_000:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _tries(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[ZFastTrie, dict, dict]]:
    """Tries of the conversations of one task, each of about ``HELD`` turns."""
    trie, owned, leaf, waiting, turns = ZFastTrie(), {}, {}, [], 0
    for row in (row for batch in batches for k in range(0, batch.num_rows, 256) for row in batch.slice(k, 256).to_pylist()):
        if "owned_from" in row:
            owned[row["conv_id"]], leaf[row["conv_id"]] = row["owned_from"], row["leaf"]
        waiting.append(_paths(row))
        turns += len(waiting[-1].names)
        if len(waiting) == BATCH or turns > HELD:
            trie.insert(waiting)
            waiting, turns = [], 0
            if trie.held > HELD:
                yield trie, owned, leaf
                trie, owned, leaf = ZFastTrie(), {}, {}
    if waiting:
        trie.insert(waiting)
    if trie.root.ends or len(trie.nodes) > 1:
        yield trie, owned, leaf


def _schema(kinds: dict[str, pa.DataType]) -> pa.Schema:
    return pa.schema(list(kinds.items()))


def expand_members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    whole = pa.int64()
    kinds = {"node": pa.binary(), "parent": pa.binary(), "depth": whole, "chars": whole, "first": whole, "n": whole}
    for trie, _, _ in _tries(batches):
        yield from _rows(members(trie), _schema({**kinds, "ends": pa.list_(whole)}))


def expand_totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    whole = pa.int64()
    for trie, owned, leaf in _tries(batches):
        yield from _rows(
            totals(trie, owned, leaf), _schema({"node": pa.binary(), "leaves": whole, "spent": whole, "own": whole})
        )


def turn_key() -> Column:
    """16 bytes that name a turn by its role and text."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    return F.unhex(F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * NAME))


def taken_over() -> Column:
    """How many turns a conversation takes from the first one of its group."""
    return F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED


def rebuilt(conversations: DataFrame) -> DataFrame:
    """``base, conv_id, keys, chars``: every conversation's turns after its group's first one
    lent it a beginning; item 0 stands for the root. One shuffle of the turns, by group."""
    own = conversations.where("conv_id is not null").select(
        (F.col("conv_id") - F.col("conv_id") % GROUP).alias("base"), F.col("conv_id").cast("long").alias("conv_id"),
        "turn", turn_key().alias("key"), F.char_length(F.coalesce("text", F.lit(""))).cast("long").alias("chars"),
    )
    order = Window.partitionBy("base", "conv_id").orderBy(F.col("turn").asc_nulls_first(), "key")
    placed = cut(own.repartition("base").select("base", "conv_id", "key", "chars", F.row_number().over(order).alias("i")), "turns")
    convs = placed.where("i = 1").select("base", "conv_id", taken_over().alias("h"))
    root = convs.select("base", "conv_id", F.lit(None).cast("binary").alias("key"), F.lit(0).cast("long").alias("chars"), F.lit(0).alias("i"))
    lent = placed.where((F.col("conv_id") == F.col("base")) & (F.col("i") < SHARED)).select("base", "key", "chars", "i")
    given = lent.join(convs, "base").where("i <= h").select("base", "conv_id", "key", "chars", "i")
    kept = placed.where(F.col("i") > taken_over()).select("base", "conv_id", "key", "chars", "i")
    rows = root.unionByName(given).unionByName(kept).repartition("base")
    turns = F.array_sort(F.collect_list(F.struct("i", "key", "chars")))
    return rows.groupBy("base", "conv_id").agg(turns.alias("turns")).select(
        "base", "conv_id", F.col("turns.key").alias("keys"), F.col("turns.chars").alias("chars")
    )


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest of the joined blocks of each node; rows come sorted by node and block."""
    node, running, out = None, None, []
    for batch in batches:
        for row in batch.to_pylist():
            if row["node"] != node:
                if node is not None:
                    out.append({"node": node, "ends_sha256": running.hexdigest()})
                node, running = row["node"], hashlib.sha256(row["ids"].encode())
            else:
                running.update(b"," + row["ids"].encode())
        yield pa.RecordBatch.from_pylist(out, _schema({"node": pa.binary(), "ends_sha256": pa.string()}))
        out = []
    if node is not None:
        out.append({"node": node, "ends_sha256": running.hexdigest()})
        yield pa.RecordBatch.from_pylist(out, _schema({"node": pa.binary(), "ends_sha256": pa.string()}))


def end_digests(ends: DataFrame) -> DataFrame:
    """``node, ends_sha256`` of ``ends(node, conv_id)``, the ids ascending and comma-joined."""
    blocks = ends.groupBy("node", F.shiftright("conv_id", BLOCK_BITS).alias("block")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids")
    )
    lined = blocks.repartition("node").sortWithinPartitions("node", "block").select("node", "ids")
    return lined.mapInArrow(_digests, "node binary, ends_sha256 string")


def prefix_nodes(conversations: DataFrame) -> DataFrame:
    """One row per node: ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``,
    ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens``, ``ends_sha256`` and the
    node's name ``node`` (binary). Runs jobs that write tables of names to the shared folder."""
    paths = cut(rebuilt(conversations), "paths")
    parts = cut(paths.select("conv_id", "keys", "chars").mapInArrow(expand_members, _MEMBERS), "parts")
    merged = parts.groupBy("node").agg(
        F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.first("chars").alias("chars"),
        F.min("first").alias("first"), F.sum("n").alias("n_convs"),
    )
    nodes = cut(merged, "nodes")
    children = nodes.where("parent is not null").groupBy("parent").agg(F.count("*").alias("n_children"))
    nodes = cut(
        nodes.join(children.withColumnRenamed("parent", "node"), "node", "left").withColumn(
            "n_children", F.coalesce("n_children", F.lit(0).cast("long"))
        ),
        "nodes",
    )
    owners = nodes.groupBy(F.col("first").alias("conv_id")).agg(
        F.min("depth").alias("owned_from"), F.max((F.col("n_children") == 0).cast("long")).alias("leaf")
    )
    told = paths.join(owners, "conv_id", "left").select(
        "base", "conv_id", "keys", "chars",
        F.coalesce("owned_from", F.lit(NEVER)).alias("owned_from"), F.coalesce("leaf", F.lit(0)).alias("leaf"),
    )
    sums = told.repartition("base").drop("base").mapInArrow(expand_totals, _TOTALS).groupBy("node").agg(
        F.sum("leaves").alias("n_leaves"), (F.sum("spent") - F.sum("own")).alias("saved_tokens")
    )
    digests = end_digests(parts.where(F.size("ends") > 0).select("node", F.explode("ends").alias("conv_id")))
    above = nodes.where("n_children > 0").select(F.col("node").alias("parent"), F.col("first").alias("parent_conv_id"))
    return (
        nodes.join(sums, "node")
        .join(digests, "node", "left")
        .join(above, "parent", "left")
        .select(
            F.col("first").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
            F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"), "node",
        )
    )
