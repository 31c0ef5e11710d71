"""Document quality from heuristics that disagree, without labels.

Several heuristic labellers vote good, bad or nothing on each document. How often they
vote alike, over all documents, tells by expectation maximisation how accurate each of
them is and how common good documents are; that gives each document a posterior. A
hashed linear scorer on character trigrams and on how often words repeat is then trained
on posteriors, and scores every document, those no heuristic speaks on included.

Votes are counted by pattern, so the maximisation sees all documents through at most
3^labellers rows. Null and empty texts are bad by their length. Other columns are not
used.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dateline.llm.words import mix, pieces
from dateline.session import cut

BITS = 15
LEVEL = 0.1  # weight of the repetition feature beside the trigrams' shares
SAMPLE_DOCS = 6_000  # documents the scorer is fitted on, at most
SAMPLE_BYTES = 16 << 20  # and their text
ROUNDS = 120
PRIOR = 0.85  # where the maximisation starts
BELIEF = ([0.3, 0.6, 0.1], [0.01, 0.69, 0.3])  # bad, nothing, good: on bad and on good documents
TRUST = 0.05
KEEP = 0.5

# Frequent short words of the languages at hand.
STOP_WORDS = "the and of to in is that der die das und ist nicht le la les et est que de el los en un una"


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def votes(docs: DataFrame) -> DataFrame:
    """The rows with ``v0`` to ``v8``, each -1 (bad), 0 (no vote) or 1 (good)."""
    text = F.coalesce("text", F.lit(""))
    split = docs.withColumn("_text", text).select(
        *docs.columns,
        "_text",
        F.split(F.trim("_text"), r"\s+", -1).alias("_ws"),
        F.split("_text", "\n", -1).alias("_lines"),
    )
    counted = split.select(
        *docs.columns,
        F.char_length("_text").alias("_chars"),
        F.size("_ws").alias("_words"),
        F.size(F.array_distinct("_ws")).alias("_distinct"),
        F.size(F.filter("_ws", lambda w: F.lower(w).isin(*STOP_WORDS.split()))).alias("_stops"),
        F.regexp_count("_text", F.lit(r"[#$%&*|<>{}\\^~=]")).alias("_symbols"),
        F.regexp_count("_text", F.lit(r"[.!?]")).alias("_ends"),
        F.regexp_count("_text", F.lit(r"[A-Z]")).alias("_capitals"),
        F.regexp_count("_text", F.lit(r"[0-9]")).alias("_digits"),
        (F.size(F.array_distinct("_lines")) / F.size("_lines")).alias("_fresh_lines"),
        F.size("_lines").alias("_n_lines"),
    )
    words, chars = F.col("_words"), F.greatest("_chars", F.lit(1))
    mean = F.col("_chars") / words
    fresh, capitals = F.col("_distinct") / words, F.col("_capitals") / chars
    several, many = words >= 5, words >= 20
    labellers = [
        _vote(words >= 30, F.col("_chars") == 0),
        _vote(F.lit(False), several & (F.col("_symbols") / words > 0.2)),
        _vote(F.lit(False), (words >= 40) & (F.col("_ends") == 0)),
        _vote(several & (F.col("_stops") / words > 0.12), many & (F.col("_stops") / words < 0.04)),
        _vote(F.lit(False), (F.col("_n_lines") >= 4) & (F.col("_fresh_lines") < 0.6)),
        _vote(F.lit(False), several & ((mean < 2.5) | (mean > 15))),
        _vote(F.lit(False), F.col("_digits") / chars > 0.3),
        _vote(F.lit(False), several & (capitals > 0.4)),
        _vote(F.lit(False), many & (fresh < 0.25)),
    ]
    return counted.select(*docs.columns, *[v.cast("tinyint").alias(f"v{k}") for k, v in enumerate(labellers)])


LABELLERS = [f"v{k}" for k in range(9)]


@dataclass
class LabelModel:
    """``given[k, c, v + 1]``: how often labeller k votes v on class c (0 bad, 1 good)."""

    prior: float
    given: np.ndarray

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        odds = np.log([1 - self.prior, self.prior])[None, :].repeat(len(patterns), 0)
        for k in range(patterns.shape[1]):
            odds += np.log(self.given[k][:, patterns[:, k] + 1].T)
        odds -= odds.max(1, keepdims=True)
        weights = np.exp(odds)
        return weights[:, 1] / weights.sum(1)


def maximise(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> LabelModel:
    """Expectation maximisation over vote patterns and how often each occurs.

    Every labeller is believed, with the weight of ``TRUST`` of all documents, to be
    better than chance; without that, labellers that speak of the same fault can turn
    the classes into something else.
    """
    m = patterns.shape[1]
    given = np.empty((m, 2, 3))
    given[:, 0], given[:, 1] = BELIEF
    model, total = LabelModel(PRIOR, given), counts.sum()
    for _ in range(rounds):
        good = model.posterior(patterns)
        weight = np.stack([(1 - good) * counts, good * counts])
        fresh = 1 + TRUST * total * given
        for k in range(m):
            for c in range(2):
                fresh[k, c] += np.bincount(patterns[:, k] + 1, weight[c], 3)
        fresh /= fresh.sum(2, keepdims=True)
        prior = float(np.clip(weight[1].sum() / total, 0.01, 0.99)) if total else PRIOR
        moved = np.abs(fresh - model.given).max()
        model = LabelModel(prior, fresh)
        if moved < 1e-7:
            break
    return model


def label_model(voted: DataFrame) -> tuple[LabelModel, np.ndarray]:
    """The model and all vote patterns that occur. Runs a job."""
    table = voted.groupBy(*LABELLERS).agg(F.count("*").alias("n")).orderBy(*LABELLERS).toArrow()
    patterns = np.stack([table.column(c).to_numpy().astype(np.int64) for c in LABELLERS], 1)
    return maximise(patterns, table.column("n").to_numpy().astype(float)), patterns


def posterior(model: LabelModel) -> Column:
    """The posterior that a row with votes is good, as sums of log odds."""
    odds = F.lit(float(np.log(model.prior / (1 - model.prior))))
    for k, name in enumerate(LABELLERS):
        ratio = np.log(model.given[k, 1] / model.given[k, 0])
        chosen = F.when(F.col(name) < 0, float(ratio[0])).when(F.col(name) == 0, float(ratio[1])).otherwise(float(ratio[2]))
        odds = odds + chosen
    return 1 / (1 + F.exp(-odds))


def _trigrams(data: np.ndarray, bits: int) -> np.ndarray:
    codes = data.astype(np.uint64)
    three = codes[:-2] | codes[1:-1] << np.uint64(8) | codes[2:] << np.uint64(16)
    return ((three + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - bits)).astype(np.int64)


def _spread(texts: list[str | None], bits: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``(trigram numbers, text of each, repetition number of each text)`` by pieces of texts."""
    for a, b, words in pieces(texts):
        data = words.data
        owner = np.repeat(np.arange(b - a), np.diff(np.append(words.first, len(data))))
        grams = _trigrams(data, bits)
        inside = owner[:-2] == owner[2:]
        n = np.bincount(words.doc, minlength=b - a)
        pairs = np.unique(mix(words.hashes() + words.doc.astype(np.uint64)), return_index=True)[1]
        fresh = np.bincount(words.doc[pairs], minlength=b - a)
        level = np.log2(n + 1).astype(np.int64) * 16 + (10 * fresh) // np.maximum(n, 1)
        yield grams[inside], owner[:-2][inside] + a, _levels(level, bits)


def _levels(level: np.ndarray, bits: int) -> np.ndarray:
    return (mix(level.astype(np.uint64) + np.uint64(1 << 40)) >> np.uint64(64 - bits)).astype(np.int64)


@dataclass
class Scorer:
    weights: np.ndarray
    offset: float
    bits: int


def _fit(bits: int, most_bytes: int) -> Callable:
    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, owners, values, targets, read = [], [], [], [], 0
        for batch in batches:
            texts, goal = batch.column("text").to_pylist(), batch.column("posterior").to_pylist()
            for part in range(0, len(texts), 64):
                some = texts[part : part + 64]
                if read > most_bytes and targets:
                    break
                read += sum(len(t or "") for t in some)
                sizes, levels = np.zeros(len(some)), []
                for grams, owner, level in _spread(some, bits):
                    keys, n = np.unique(owner << bits | grams, return_counts=True)
                    sizes += np.bincount(owner, minlength=len(some))
                    cells.append(keys & ((1 << bits) - 1))
                    owners.append((keys >> bits) + len(targets))
                    values.append(n / sizes[keys >> bits])
                    levels.append(level)
                cells.append(np.concatenate(levels))
                owners.append(np.arange(len(some)) + len(targets))
                values.append(np.full(len(some), LEVEL))
                targets += goal[part : part + 64]
        weights, offset, target = np.zeros(1 << bits), 0.0, np.array(targets, float)
        if cells:
            cell, owner, value = np.concatenate(cells), np.concatenate(owners), np.concatenate(values)
            seen = np.full((1 << bits) + 1, 1e-12)
            for _ in range(ROUNDS):
                z = np.bincount(owner, weights[cell] * value, len(target)) + offset
                miss = 1 / (1 + np.exp(-np.clip(z, -40, 40))) - target
                slope = np.bincount(cell, miss[owner] * value, 1 << bits) + 1e-4 * weights
                seen[:-1] += slope * slope
                seen[-1] += miss.sum() ** 2
                weights -= 8.0 * slope / np.sqrt(seen[:-1])
                offset -= 1.0 * miss.sum() / np.sqrt(seen[-1])
        keep = np.flatnonzero(weights)
        yield pa.record_batch(
            {"feature": pa.array(np.append(keep, -1)), "weight": pa.array(np.append(weights[keep], offset))}
        )

    return fit


def fit_scorer(
    docs: DataFrame, model: LabelModel, sample_docs: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES, bits: int = BITS
) -> Scorer:
    """Fit on ``docs(doc_id, text)`` and their posteriors: at most ``sample_docs`` documents
    and ``sample_bytes`` of text, in the order of a hash of the row, by one task; of equal
    rows one is read. The weights (2^bits at most) come to the driver."""
    marked = docs.select("text", F.xxhash64("doc_id", "text").alias("h"))
    last = marked.select("h").distinct().orderBy("h").limit(sample_docs).agg(F.max("h")).first()[0]
    chosen = cut(marked.where(F.col("h") <= F.lit(last)).dropDuplicates(["h"]), "sample")
    labelled = votes(chosen).withColumn("posterior", posterior(model))
    one = labelled.repartition(1).sortWithinPartitions("h").select("text", "posterior")
    found = one.mapInArrow(_fit(bits, sample_bytes), "feature long, weight double").toArrow()
    names, values = found.column("feature").to_numpy(), found.column("weight").to_numpy()
    weights = np.zeros(1 << bits)
    weights[names[names >= 0]] = values[names >= 0]
    return Scorer(weights, float(values[names < 0].sum()), bits)


def score(scorer: Scorer, text: Column) -> Column:
    """Between 0 and 1, higher for good documents; texts without trigrams get 0."""

    def scores(texts: pa.Array) -> pa.Array:
        values, at = texts.to_pylist(), 0
        sums, sizes, levels = np.zeros(len(values)), np.zeros(len(values)), np.zeros(len(values))
        for grams, owner, level in _spread(values, scorer.bits):
            sums += np.bincount(owner, scorer.weights[grams], len(values))
            sizes += np.bincount(owner, minlength=len(values))
            levels[at : at + len(level)] = scorer.weights[level]
            at += len(level)
        z = sums / np.maximum(sizes, 1) + LEVEL * levels + scorer.offset
        return pa.array(np.where(sizes > 0, 1 / (1 + np.exp(-np.clip(z, -40, 40))), 0.0))

    return F.arrow_udf(scores, "double")(text)


def scored(docs: DataFrame) -> DataFrame:
    """``doc_id, posterior, score, keep``, one row a document. Runs jobs."""
    texts = docs.select("doc_id", "text")
    model, _ = label_model(votes(texts))
    scorer = fit_scorer(texts, model)
    rated = votes(texts).select("doc_id", posterior(model).alias("posterior"), score(scorer, F.col("text")).alias("score"))
    return rated.withColumn("keep", F.col("score") >= KEEP)
