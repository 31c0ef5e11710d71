"""Phrases whose words keep company more often than chance, by language.

Texts are cut at punctuation into pieces and pieces into words. A phrase of two to five
words that occurs ``LEAST`` times in a language is a candidate; its score compares how often
it occurs with what its two parts would give by chance, at the cut where that is lowest.

1. Texts become rows of word codes once, a language at a time, with 0 between pieces, beside
   the ids of the row's distinct words. An id is a seeded 64-bit hash; the distinct words of
   the corpus are checked for two words of one id, and encoded anew with another seed if
   there are any, so ids are exact.
2. Phrases grow word by word. A phrase of k words can only be frequent when its first and its
   last k - 1 words are (Apriori). Those known are a double-array trie, broadcast to the
   tasks, where numpy advances the states of all positions of a row together, level by
   level; positions whose window and whose next window are both alive hold the only phrases
   that can pass, which are counted per task, added up by Spark, and kept from ``LEAST`` on.
3. The candidates of all lengths are then counted by one more trie: at every level the
   accepting states are counted by ``bincount`` and the tasks' vectors added up.
4. Scores, cuts and containment are joins and aggregations of counts in exact arithmetic.

A trie holds at most ``SHARD`` phrases, which bounds what is broadcast and what the driver
holds at a time; more phrases are dealt over several tries, one pass over the ids each.
Within several tries the test of a phrase's last words is left to the counts.

Null texts are empty and a null language is ``und``. Repeated rows count each. Empty tables
give no phrases. Only ``text`` and ``lang`` are read. A task's memory follows ``CHUNK``, the
trie, and the longest stretch of text without punctuation.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from xxhash import xxh3_64_intdigest

from dateline.llm.batches import rows_per_batch
from dateline.session import cut

LEAST = 100  # occurrences of a candidate
LONGEST = 5  # words of a candidate
TOP = 2000  # phrases returned per language
INSIDE = 100  # percent of a phrase's occurrences within one longer phrase that make it a part
SHARD = 1_000_000  # phrases of a trie at most
CHUNK = 1 << 20  # bytes of text that become a row
HELD = 16 * CHUNK  # bytes held for all languages together
FLUSH = 1 << 19  # windows counted before they leave a task
TEXTS, ROWS = 512, 8  # texts, and rows of codes, that go to Python at a time
SENT = 1 << 16  # rows that leave a task at a time
WINDOW = 256  # children of a state, and the room of a large one
WIDE = 16  # children from which a state gets a room of its own

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_BREAK_AT = re.compile(rb"[.,;:!?\n-\r]")
_BYTE = np.arange(256)
_BREAK = np.isin(_BYTE, list(b".,;:!?")) | (_BYTE >= 0x0A) & (_BYTE <= 0x0D)
_OUTSIDE = _BREAK | (_BYTE == 0x20) | (_BYTE == 0x09)


def _encoded(data: bytes, seed: int) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray]:
    """``(codes, distinct words, their ids, their numbers)`` of lower-cased pieces: a code is
    the place of a word among the distinct ones, from 1, or 0 between pieces."""
    text = np.frombuffer(data, np.uint8)
    inside = ~_OUTSIDE[text]
    edges = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0, append=0))
    start, stop = edges[::2], edges[1::2]
    if not len(start):
        return np.zeros(0, np.int32), [], np.zeros(0, np.int64), np.zeros(0, np.int64)
    offsets = np.zeros(len(start) + 1, np.int64)
    np.cumsum(stop - start, out=offsets[1:])
    words = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(text[inside])])
    coded = words.dictionary_encode()
    distinct = coded.dictionary.to_pylist()
    names = np.fromiter((xxh3_64_intdigest(w, seed) or 1 for w in distinct), np.uint64, len(distinct)).view(np.int64)
    index = coded.indices.to_numpy()
    breaks = np.searchsorted(np.flatnonzero(_BREAK[text]), start)
    parts = np.cumsum(np.diff(breaks, prepend=breaks[0]) > 0)
    codes = np.zeros(len(start) + int(parts[-1]), np.int32)
    codes[np.arange(len(start)) + parts] = index + 1
    return codes, distinct, names, np.bincount(index, minlength=len(distinct))


def _slices(data: bytes) -> Iterator[bytes]:
    """A text in slices that end at punctuation, so that no phrase is cut."""
    at = 0
    while len(data) - at > CHUNK:
        found = _BREAK_AT.search(data, at + CHUNK)
        if found is None:
            break
        yield data[at : found.start()]
        at = found.end()
    yield data[at:]


# Rows of words and rows of texts lie in one table, so that texts are read once.
_ROWS = "lang string, word string, id long, n long, names binary, codes binary"
_KINDS = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
_NAMES = [part.split()[0] for part in _ROWS.split(", ")]


def _encode(seed: int) -> Callable:
    def batch(size: int, /, **columns: list | pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(columns[c], k) if c in columns else pa.nulls(size, k) for c, k in zip(_NAMES, _KINDS)], _NAMES
        )

    def row(lang: str, held: list[bytes]) -> Iterator[pa.RecordBatch]:
        codes, words, names, n = _encoded(b"\n".join(held), seed)
        langs = [lang] * len(words)
        yield batch(len(words), lang=langs, word=[w.decode() for w in words], id=names, n=n)
        yield batch(1, lang=[lang], names=[names.tobytes()], codes=[codes.tobytes()])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[bytes]] = {}
        sizes: dict[str, int] = {}
        for batch in (b.slice(k, 256) for b in batches for k in range(0, b.num_rows, 256)):
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                for part in _slices((text or "").encode("utf-8", "replace").translate(_LOWER)):
                    held.setdefault(lang, []).append(part)
                    sizes[lang] = sizes.get(lang, 0) + len(part) + 1
                    if sizes[lang] >= CHUNK:
                        yield from row(lang, held.pop(lang))
                        del sizes[lang]
            if sum(sizes.values()) > HELD:
                for lang, some in held.items():
                    yield from row(lang, some)
                held, sizes = {}, {}
        for lang, some in held.items():
            yield from row(lang, some)

    return encode


def encoded(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(rows(lang, names, codes), words(lang, word, id, n))``, ids without collisions. Runs jobs."""
    texts = docs.select(F.coalesce("lang", F.lit("und")).cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    for seed in count():
        with rows_per_batch(docs.sparkSession, TEXTS):
            rows = cut(texts.mapInArrow(_encode(seed), _ROWS), "ids")
        words = rows.where("word is not null").groupBy("lang", "word", "id").agg(F.sum("n").alias("n"))
        words = cut(words, "words")
        if words.groupBy("id").agg((F.min("word") < F.max("word")).alias("two")).where("two").isEmpty():
            return rows.where("codes is not null").select("lang", "names", "codes"), words


@dataclass
class DoubleArray:
    """A trie over words in base 256: ``base[s] + digit`` is the next state if ``check`` of it is ``s``.

    ``phrase[s]`` is the number of the phrase accepted at ``s``, or -1. State 0 is dead.
    """

    words: np.ndarray  # sorted ids
    digits: int
    roots: dict[str, int]
    base: np.ndarray
    check: np.ndarray
    phrase: np.ndarray

    def symbols(self, names: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of every place: the index of its id among the words, and whether it is one."""
        at = np.minimum(np.searchsorted(self.words, names), len(self.words) - 1)
        known = self.words[at] == names
        return np.append(0, at)[codes], np.append(False, known)[codes]

    def advance(self, states: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """The states one word on; states and symbols are those of live positions."""
        for k in range(self.digits - 1, -1, -1):
            following = self.base[states] + (symbols >> (8 * k) & 255)
            states = np.where(self.check[following] == states, following, 0)
        return states

    def levels(
        self, root: int, symbols: np.ndarray, known: np.ndarray, depth: int
    ) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """After each word: the positions still alive, and their states."""
        places = np.flatnonzero(known)
        states = np.full(len(places), root, np.int32)
        for level in range(depth):
            at = places + level
            inside = at < len(symbols)
            places, states, at = places[inside], states[inside], at[inside]
            alive = known[at]
            places, states, at = places[alive], states[alive], at[alive]
            states = self.advance(states, symbols[at])
            alive = states > 0
            places, states = places[alive], states[alive]
            yield places, states


def double_array(langs: list[str], phrases: list[bytes]) -> DoubleArray:
    """The trie of phrases, each 8 bytes a word, in its language."""
    sizes = np.array([len(p) // 8 for p in phrases])
    flat = np.frombuffer(b"".join(phrases), ">i8").astype(np.int64)
    words, index = np.unique(flat, return_inverse=True)
    digits = max(1, -(-max(len(words) - 1, 1).bit_length() // 8))
    names, lang = np.unique(np.array(langs, object), return_inverse=True)
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    # Nodes are numbered level by level; a level has one digit of one word.
    node = lang.astype(np.int64)
    parents, symbols, total = [], [], len(names)
    last = np.zeros(len(phrases), np.int64)
    live = np.arange(len(phrases))
    for level in range(int(sizes.max(initial=0))):
        live = live[sizes[live] > level]
        for k in range(digits - 1, -1, -1):
            digit = index[first[live] + level] >> (8 * k) & 255
            keys, inverse = np.unique(node[live] * 256 + digit, return_inverse=True)
            parents.append(keys >> 8)
            symbols.append(keys & 255)
            node[live] = total + inverse
            total += len(keys)
        last[live] = node[live]
    parent = np.concatenate([np.zeros(0, np.int64), *parents])
    symbol = np.concatenate([np.zeros(0, np.int64), *symbols])
    base, state = _placed(parent, symbol, len(names), total)
    room = int(max(state.max(initial=0), base.max(initial=0))) + WINDOW + 1
    bases, check, phrase = np.zeros(room, np.int32), np.full(room, -1, np.int32), np.full(room, -1, np.int32)
    bases[state] = base
    check[state[len(names) :]] = state[parent]
    phrase[state[last]] = np.arange(len(phrases))
    return DoubleArray(words, digits, {str(n): int(state[k]) for k, n in enumerate(names)}, bases, check, phrase)


def _placed(parent: np.ndarray, symbol: np.ndarray, roots: int, total: int) -> tuple[np.ndarray, np.ndarray]:
    """A base for every node so that no two children share a slot, and every node's state.

    Edges come ordered by parent. States with many children get a room each; the others try
    places at random, all together, and those that collide try again.
    """
    base = np.zeros(total, np.int64)
    edges = np.bincount(parent, minlength=total)
    begin = np.cumsum(edges) - edges
    free = WINDOW + roots  # the dead state's room, then the roots
    wide = np.flatnonzero(edges >= WIDE)
    base[wide] = free + WINDOW * np.arange(len(wide))
    free += WINDOW * len(wide)
    few = np.flatnonzero((edges > 0) & (edges < WIDE))
    room = 4 * int(edges[few].sum()) + WINDOW
    taken = np.zeros(room + WINDOW, bool)
    draw = np.random.default_rng(0)
    waiting = few[np.argsort(-edges[few], kind="stable")]
    while len(waiting):
        tried = draw.integers(0, room, len(waiting))
        n = edges[waiting]
        owner = np.repeat(np.arange(len(waiting)), n)
        edge = np.repeat(begin[waiting] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        slot = tried[owner] + symbol[edge]
        lost = taken[slot]
        order = np.argsort(slot, kind="stable")
        same = np.flatnonzero(slot[order][1:] == slot[order][:-1]) + 1
        lost[order[same]] = True
        fits = np.bincount(owner[lost], minlength=len(waiting)) == 0
        taken[slot[fits[owner]]] = True
        base[waiting[fits]] = free + tried[fits]
        waiting = waiting[~fits]
    state = np.concatenate([WINDOW + np.arange(roots), base[parent] + symbol])
    return base, state


def _tries(phrases: DataFrame) -> Iterator[tuple[DoubleArray, DataFrame, bool]]:
    """Tries of ``phrases(lang, key)``: each with ``phrase, lang, key`` of what it holds and
    whether it is the only one."""
    n = phrases.count()
    shards = -(-n // SHARD)
    spark = phrases.sparkSession
    for k in range(shards):
        some = phrases.where(F.pmod(F.xxhash64("lang", "key"), F.lit(shards)) == k).select("lang", "key").toArrow()
        trie = double_array(some.column("lang").to_pylist(), some.column("key").to_pylist())
        numbered = some.append_column("phrase", pa.array(np.arange(len(some)), pa.int64()))
        yield trie, spark.createDataFrame(numbered), shards == 1


def _arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    for batch in batches:
        for lang, names, codes in zip(*[batch.column(c) for c in ("lang", "names", "codes")]):
            yield lang.as_py(), np.frombuffer(names.as_buffer(), np.int64), np.frombuffer(codes.as_buffer(), np.int32)


def _grown(shared, words: int, only: bool) -> Callable:
    """Counts what can be a frequent phrase of one word more than the trie's."""

    def tally(keys: list[np.ndarray], following: list[np.ndarray], words: np.ndarray) -> Iterator[pa.RecordBatch]:
        phrase, last = np.concatenate(keys), np.concatenate(following)
        if not only:
            words, last = np.unique(last, return_inverse=True)
        pairs, n = np.unique(phrase << 32 | last, return_counts=True)
        for k in range(0, len(pairs), SENT):
            some = pairs[k : k + SENT]
            yield pa.RecordBatch.from_arrays(
                [pa.array(some >> 32), pa.array(words[some & 0xFFFFFFFF]), pa.array(n[k : k + SENT])], ["phrase", "last", "n"]
            )

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, keys, following, held = shared.value, [], [], 0
        for lang, names, codes in _arrays(batches):
            if lang not in trie.roots or not len(codes):
                continue
            symbols, known = trie.symbols(names, codes)
            *_, (places, states) = trie.levels(trie.roots[lang], symbols, known, words)
            if only:  # the next window is alive too
                alive = np.zeros(len(codes) + 1, bool)
                alive[places] = True
                both = np.flatnonzero(alive[places + 1])
            else:  # a word follows
                both = np.flatnonzero(np.append(codes, 0)[np.minimum(places + words, len(codes))])
            after = places[both] + words
            keys.append(trie.phrase[states[both]].astype(np.int64))
            following.append(symbols[after] if only else names[codes[after] - 1])
            held += len(both)
            if held > FLUSH:
                yield from tally(keys, following, trie.words)
                keys, following, held = [], [], 0
        if held:
            yield from tally(keys, following, trie.words)

    return grow


def _counted(shared, longest: int) -> Callable:
    """Counts the trie's phrases: accepting states, level by level, over all rows of a task."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = shared.value
        total = np.zeros(len(trie.base), np.int64)
        for lang, names, codes in _arrays(batches):
            if lang in trie.roots:
                for _, states in trie.levels(trie.roots[lang], *trie.symbols(names, codes), longest):
                    seen = np.bincount(states)
                    total[: len(seen)] += seen
        found = np.flatnonzero((total > 0) & (trie.phrase >= 0))
        yield pa.RecordBatch.from_arrays(
            [pa.array(trie.phrase[found].astype(np.int64)), pa.array(total[found])], ["phrase", "n"]
        )

    return tally


def _key(number: Column) -> Column:
    """8 bytes of a long, the highest first."""
    return F.unhex(F.lpad(F.hex(number), 16, "0"))


def _longer(rows: DataFrame, phrases: DataFrame, words: int, least: int) -> DataFrame:
    """``lang, key`` of the frequent phrases of one word more than ``phrases``. Runs jobs."""
    found = []
    for trie, names, only in _tries(phrases):
        shared = rows.sparkSession.sparkContext.broadcast(trie)
        counts = rows.mapInArrow(_grown(shared, words, only), "phrase long, last long, n long")
        enough = counts.groupBy("phrase", "last").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
        key = F.concat("key", _key(F.col("last"))).alias("key")
        with rows_per_batch(rows.sparkSession, ROWS):
            found.append(cut(enough.join(names, "phrase").select("lang", key), "grown"))
        shared.unpersist()
    return reduce(DataFrame.unionByName, found) if found else phrases.limit(0)


def counted(rows: DataFrame, phrases: DataFrame, longest: int) -> DataFrame:
    """``lang, key, a`` of ``phrases(lang, key)``: how often each occurs. Runs jobs.

    A task sends one count a phrase, so the rows are dealt to a number of tasks that
    follows the cores, not the input.
    """
    found = []
    rows = rows.coalesce(2 * rows.sparkSession.sparkContext.defaultParallelism)
    for trie, names, _ in _tries(phrases):
        shared = rows.sparkSession.sparkContext.broadcast(trie)
        sums = rows.mapInArrow(_counted(shared, longest), "phrase long, n long").groupBy("phrase").agg(F.sum("n").alias("a"))
        with rows_per_batch(rows.sparkSession, ROWS):
            found.append(cut(sums.join(names, "phrase").select("lang", "key", "a"), "counts"))
        shared.unpersist()
    return reduce(DataFrame.unionByName, found) if found else phrases.withColumn("a", F.lit(0).cast("long")).limit(0)


def _part(start: Column, n: Column) -> Column:
    return F.substring(F.col("key"), 8 * start + 1, 8 * n)


def candidates(docs: DataFrame, least: int = LEAST, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """``(phrases(lang, key, a), words(lang, word, id, n))`` of two to ``longest`` words. Runs jobs."""
    rows, words = encoded(docs)
    known = words.where(F.col("n") >= least).select("lang", _key(F.col("id")).alias("key"))
    levels = []
    for size in range(1, longest):
        known = _longer(rows, known, size, least)
        if known.isEmpty():
            break
        levels.append(known)
    phrases = reduce(DataFrame.unionByName, levels) if levels else known.limit(0)
    return counted(rows, phrases, longest), words


def collocations(
    docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, inside: int = INSIDE
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the first ``top`` phrases of every language. Runs jobs."""
    phrases, words = candidates(docs, least, longest)
    sizes = words.groupBy("lang").agg(F.sum("n").alias("n"))
    frequent = words.where(F.col("n") >= least).select("lang", "word", _key(F.col("id")).alias("key"), F.col("n").alias("f"))
    counts = frequent.select("lang", "key", "f").unionByName(phrases.select("lang", "key", F.col("a").alias("f")))
    length = F.expr("cast(octet_length(key) div 8 as int)")
    sized = phrases.withColumn("words", length)

    cuts = sized.select("lang", "key", "words", "a", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    parts = cuts.select("lang", "key", "a", "k", _part(F.lit(0), F.col("k")).alias("one"), _part(F.col("k"), F.col("words")).alias("other"))
    both = parts.join(counts.toDF("lang", "one", "l"), ["lang", "one"]).join(counts.toDF("lang", "other", "r"), ["lang", "other"])
    exact = "cast(1000 as decimal(4,0)) * cast(a as decimal(17,0)) * cast(n as decimal(17,0))"
    chance = "(cast(l as decimal(19,0)) * cast(r as decimal(19,0)))"
    scored = both.join(sizes, "lang").withColumn("score", F.expr(f"({exact}) div {chance}"))
    lowest = scored.groupBy("lang", "key").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("s"))

    wider = sized.where("words > 2").select("lang", "key", "words", "a", F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("m"))
    within = wider.select("lang", "key", "a", "m", F.explode(F.sequence(F.lit(0), F.col("words") - F.col("m"))).alias("at"))
    held = within.groupBy("lang", _part(F.col("at"), F.col("m")).alias("key")).agg(F.max("a").alias("longer"))
    alone = lowest.join(held, ["lang", "key"], "left").where(
        f"longer is null or cast(100 as decimal(3,0)) * longer < cast({inside} as decimal(10,0)) * s.a"
    )
    spelled = alone.select("lang", "key", "s.*", F.posexplode(F.sequence(F.lit(0), length - 1)).alias("at", "_"))
    spelled = spelled.select("*", _part(F.col("at"), F.lit(1)).alias("w")).join(
        frequent.select("lang", F.col("key").alias("w"), "word"), ["lang", "w"]
    )
    texts = spelled.groupBy("lang", "key", "a", "l", "r", "n", "score").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda p: p["word"]), " ").alias("phrase")
    )
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    ranked = texts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
