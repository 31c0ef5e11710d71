"""Benchmark items in documents, also with other numbers, names and units.

A text is read as words; numbers, names (capitalised words inside a sentence) and units
after a number become typed placeholders. Windows of ``WINDOW`` words of documents and
benchmark items are joined by hash, in this template form, in one in which a capitalised
word that opens a sentence is a name too, and as plain lower-case words. Where other values
met at placeholders, they must map consistently: one value of the item always to the same
value of the document, along one alignment; windows of equal values always count.

An item is found in a document when at least ``share`` of its windows are: of all, or of
those that a template form can match; in the latter case the windows found must also cover
that share of the item's words, or two windows' length, so that the one short window of an item
dense in numbers is no hit. A template window needs ``LITERAL`` plain words, or tables of
numbers would match. A run of verbatim windows of ``RUN`` words is also enough.
Items of fewer than ``WINDOW`` words are found by one plain window of their own length.
Null and empty texts hold nothing. Rows of one ``doc_id`` with different texts are judged separately; rows
without an id too.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dateline.llm.batches import TEXTS, rows_per_batch
from dateline.llm.words import Words, mix, pieces
from dateline.session import broadcast_within, cut

WINDOW = 5
LITERAL = 3
SHARE = 0.5
RUN = 13  # words of an item in a row that are a leak by themselves
FILTER_HASHES = 8 << 20  # benchmark windows that tasks may hold to skip documents' others

# Words that are read as numbers and as units.
NUMBERS = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen "
    "sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety "
    "hundred thousand million billion half dozen"
).split()
UNITS = (
    "mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms "
    "ounce ounces pound pounds ton tons ml l liter liters litre litres gallon gallons ms s second "
    "seconds minute minutes hour hours day days week weeks month months year years meter meters "
    "metre metres kilometer kilometers kilometre kilometres degree degrees celsius fahrenheit kelvin "
    "percent dollar dollars cent cents euro euros volt volts watt watts joule joules newton newtons "
    "hz khz mhz ghz kb mb gb tb bytes bits kmh mph"
).split()

_NUMBER, _NAME, _UNIT = (np.uint64(k) for k in (11, 12, 13))
_STEP = 0xC2B2AE3D27D4EB4F
_WINDOWS = "array<struct<hash: long, pos: int, slots: array<long>, size: int, forms: int>>"
_WINDOW_TYPE = pa.list_(
    pa.struct([
        ("hash", pa.int64()), ("pos", pa.int32()), ("slots", pa.list_(pa.int64())), ("size", pa.int32()),
        ("forms", pa.int32()),
    ])
)


def _known(words: list[str]) -> np.ndarray:
    return np.sort(next(pieces([" ".join(words)]))[2].hashes())


def _within(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(values), bool)
    return table[np.minimum(np.searchsorted(table, values), len(table) - 1)] == values


def template(words: Words, numbers: np.ndarray, units: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of every plain word, of its form in the template, and of that with openers as names."""
    plain = words.hashes()
    opens = np.diff(words.sentence, prepend=-1) != 0
    number = words.digit() | _within(plain, numbers)
    after = np.concatenate([[False], number[:-1]]) & ~opens & ~number
    unit = after & _within(plain, units)
    name = words.capital() & ~number & ~unit
    typed = plain.copy()
    typed[number], typed[name & ~opens], typed[unit] = _NUMBER, _NAME, _UNIT
    opened = typed.copy()
    opened[name] = _NAME
    return plain, typed, opened


def _hashes(codes: np.ndarray, n: int, window: int) -> np.ndarray:
    total, power = np.zeros(n, np.uint64), 1
    for j in range(window):
        total += codes[j : j + n] * np.uint64(power)
        power = power * _STEP % (1 << 64)
    return mix(total)


def windows(
    text: Column, window: int = WINDOW, wanted: np.ndarray | None = None, short: list[int] | None = None
) -> Column:
    """Windows of a text with the values of their placeholders, how many words they have and
    how many template forms can match them; only ``wanted`` hashes (sorted) if given.

    A window comes in every form that it has. Of the sizes in ``short`` plain windows are
    added; without ``short``, a text of fewer than ``window`` words gives one, the whole.
    """

    def find(texts: pa.Array) -> pa.Array:
        numbers, units = _known(NUMBERS), _known(UNITS)
        out: list[list[tuple]] = [[] for _ in texts]
        for a, _, words in pieces(texts.to_pylist()):
            if not len(words.start):
                continue
            plain, typed, opened = template(words, numbers, units)
            first = np.searchsorted(words.doc, words.doc)

            def add(size: int, codes: np.ndarray, fit: np.ndarray, forms: np.ndarray) -> None:
                hashes = _hashes(codes, len(fit), size).view(np.int64)
                if wanted is not None:
                    fit = fit & _within(hashes, wanted)
                for k in np.flatnonzero(fit):
                    spots = k + np.flatnonzero(codes[k : k + size] != plain[k : k + size])
                    values = (plain[spots] ^ codes[spots]).view(np.int64).tolist()
                    out[a + words.doc[k]].append((int(hashes[k]), int(k - first[k]), values, size, int(forms[k])))

            n = len(words.start) - window + 1
            if n > 0:
                whole = words.doc[:n] == words.doc[window - 1 :]
                few, more = (
                    np.diff(np.concatenate([[0], np.cumsum(codes != plain)])[[np.arange(n), np.arange(n) + window]], axis=0)[0]
                    for codes in (typed, opened)
                )
                most = window - LITERAL
                forms = (few <= most).astype(int) + (more <= most)
                add(window, typed, whole & (few <= most), forms)
                add(window, opened, whole & (more > few) & (more <= most), forms)
                add(window, plain, whole & (few > 0), forms)
            lengths = np.bincount(words.doc)[words.doc]
            for size in np.unique(lengths[lengths < window]).tolist() if short is None else short:
                n = len(words.start) - size + 1
                if n > 0:
                    fit = lengths[:n] == size if short is None else np.ones(n, bool)
                    add(size, plain, fit & (words.doc[:n] == words.doc[size - 1 :]), np.zeros(n, int))
        names = _WINDOW_TYPE.value_type.names
        return pa.array([[dict(zip(names, row)) for row in rows] for rows in out], _WINDOW_TYPE)

    return F.arrow_udf(find, _WINDOWS)(text)


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``item_id, item_mark, hash, item_pos, item_slots, size, forms`` and of the item ``n_all,
    n_typed, n_opened``: its windows, and those that the template forms can match (runs a job)."""
    found = benchmark.select(
        "item_id", F.xxhash64("text").alias("item_mark"), windows(F.col("text"), window).alias("w")
    )
    flat = found.select("item_id", "item_mark", F.explode_outer("w").alias("w")).where("w is not null")
    flat = flat.select(
        "item_id", "item_mark", F.col("w.hash").alias("hash"), F.col("w.pos").alias("item_pos"),
        F.col("w.slots").alias("item_slots"), "w.size", "w.forms",
    ).distinct()
    flat = cut(flat, "items")
    sizes = flat.groupBy("item_id", "item_mark").agg(
        (F.max("item_pos") + 1).alias("n_all"),
        F.count_distinct(F.when(F.col("forms") > 0, F.col("item_pos"))).alias("n_typed"),
        F.count_distinct(F.when(F.col("forms") > 1, F.col("item_pos"))).alias("n_opened"),
    )
    return cut(
        flat.join(
            sizes.withColumnsRenamed({"item_id": "_i", "item_mark": "_m"}),
            F.col("item_id").eqNullSafe(F.col("_i")) & (F.col("item_mark") == F.col("_m")),
        ).drop("_i", "_m"),
        "items",
    )


def _longest_run(spots: Column) -> Column:
    """The most consecutive numbers in an array of different ones."""
    start = F.struct(F.lit(-2).alias("last"), F.lit(0).alias("n"), F.lit(0).alias("best"))

    def step(held: Column, spot: Column) -> Column:
        n = F.when(spot == held["last"] + 1, held["n"] + 1).otherwise(F.lit(1))
        return F.struct(spot.alias("last"), n.alias("n"), F.greatest(held["best"], n).alias("best"))

    return F.aggregate(F.array_sort(spots), start, step, lambda held: held["best"])


def _covered(spots: Column, window: int) -> Column:
    """How many words the windows that begin at these different places cover."""
    start = F.struct(F.lit(-window).alias("last"), F.lit(0).alias("n"))

    def step(held: Column, spot: Column) -> Column:
        return F.struct(spot.alias("last"), (held["n"] + F.least(spot - held["last"], F.lit(window))).alias("n"))

    return F.aggregate(F.array_sort(spots), start, step, lambda held: held["n"])


def leaks(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: float = SHARE,
    filter_hashes: int = FILTER_HASHES, run: int = RUN,
) -> DataFrame:
    """``doc_id, mark, item_id, n_windows, n_found, n_same, kind`` of items found in documents.

    ``kind`` is ``verbatim`` when the windows of equal values reach the share or a run of
    them ``run`` words, else ``reparameterised``. ``n_windows`` counts the item's windows
    that the judged form can match, ``n_found`` those found, ``n_same`` all of equal values.
    Runs jobs on the benchmark. While it has at most ``filter_hashes`` windows, tasks
    skip windows that no item has; beyond that all windows go to the join.
    """
    items = item_windows(benchmark, window)
    hashes = items.select("hash").distinct()
    wanted = None
    if hashes.limit(filter_hashes + 1).count() <= filter_hashes:
        wanted = np.sort(hashes.toArrow().column("hash").to_numpy())
    short = sorted(r["size"] for r in items.where(F.col("size") < window).select("size").distinct().collect())
    found = docs.select(
        "doc_id", F.xxhash64("text").alias("mark"), windows(F.col("text"), window, wanted, short).alias("w")
    )
    seen = found.select("doc_id", "mark", F.explode_outer("w").alias("w")).where("w is not null").select(
        "doc_id", "mark", F.col("w.hash").alias("hash"), F.col("w.pos").alias("pos"), F.col("w.slots").alias("slots")
    )
    met = seen.join(broadcast_within(items, F.lit(112)), "hash")
    pair = ["doc_id", "mark", "item_id", "item_mark", "n_all", "n_typed", "n_opened"]
    equal, spot = F.col("slots") == F.col("item_slots"), F.struct("item_pos", "forms")
    aligned = met.groupBy(*pair, (F.col("pos") - F.col("item_pos")).alias("shift")).agg(
        F.collect_set(spot).alias("spots"),
        F.collect_set(F.when(equal, spot)).alias("same"),
        F.array_distinct(
            F.flatten(F.collect_set(F.when(~equal, F.arrays_zip(F.col("item_slots").alias("i"), F.col("slots").alias("d")))))
        ).alias("values"),
    )
    # Along one alignment a value of the item stands for one value of the document, in
    # windows that need their placeholders; the others count in any case.
    steady = F.size("values") == F.size(F.array_distinct(F.transform("values", lambda v: v["i"])))
    spots = aligned.select(
        *pair, "same", _longest_run(F.col("same.item_pos")).alias("run"),
        F.explode(F.when(steady, F.col("spots")).otherwise(F.col("same"))).alias("spot"),
    )
    per_spot = spots.groupBy(*pair, "spot").agg(
        F.max(F.array_contains("same", F.col("spot"))).alias("same"), F.max("run").alias("run")
    )
    counted = per_spot.groupBy(*pair).agg(
        F.count("*").alias("n_found"), F.count_if("same").alias("n_same"), F.max("run").alias("run"),
        F.count_if(F.col("spot.forms") > 0).alias("typed"), F.count_if(F.col("spot.forms") > 1).alias("opened"),
        _covered(F.collect_set("spot.item_pos"), window).alias("covered"),
    )
    wide = F.col("covered") >= F.least(F.lit(2.0 * window), share * (F.col("n_all") + window - 1))

    def reaches(n: str, of: str) -> Column:
        return (F.col(n) > 0) & (F.col(n) >= share * F.col(of))

    verbatim = reaches("n_same", "n_all") | (F.col("run") + window - 1 >= run)
    judged = F.when(verbatim | reaches("n_found", "n_all"), F.struct(F.col("n_all").cast("long").alias("n"), F.col("n_found").alias("k")))
    for form in ("typed", "opened"):
        judged = judged.when(wide & reaches(form, f"n_{form}"), F.struct(F.col(f"n_{form}").alias("n"), F.col(form).alias("k")))
    hit = counted.withColumn("judged", judged).where("judged is not null")
    kind = F.when(verbatim, "verbatim").otherwise("reparameterised")
    return hit.select(
        "doc_id", "mark", "item_id", F.col("judged.n").alias("n_windows"), F.col("judged.k").alias("n_found"), "n_same",
        kind.alias("kind"),
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame, **options: object) -> DataFrame:
    """Documents in which no item is found; all columns stay. Runs jobs."""
    with rows_per_batch(docs.sparkSession, TEXTS):
        bad = cut(leaks(docs, benchmark, **options).select("doc_id", "mark").distinct(), "leaks").toDF("_id", "_of")
    small = broadcast_within(bad, F.lit(48))
    same = docs["doc_id"].eqNullSafe(small["_id"]) & (F.xxhash64(docs["text"]) == small["_of"])
    return docs.join(small, same, "left_anti")
