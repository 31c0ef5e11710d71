"""Toxic documents by multiple-instance learning, and the sentences that make them so.

Only documents are labelled. Every sentence gets a probability from a hashed linear
model; a document is toxic when one of its sentences is (noisy-or), and the model is
fitted to the document labels through that rule. The sentence probabilities then say
where the offence is.

Features of a sentence are its words and the beginnings of its longer words. Null and
empty texts have no sentence; they get the score of the fitted offset alone. Labels
that are null are left out; a document labelled twice counts twice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dateline.llm.batches import TEXTS, rows_per_batch
from dateline.llm.words import Words, pieces

STEM = 5  # bytes of a word's beginning that make a feature of their own
SAMPLE_DOCS = 12_000  # labelled documents, of each class, that a fit reads at most
SAMPLE_BYTES = 20 << 20  # and their text, of both classes together
BITS = 20
UNTAUGHT = -20.0
BLOCK = 1 << 20  # word places summed at a time
THRESHOLD = 0.7  # documents at or above it are predicted toxic
ROUNDS = 200
RIDGE = 0.002
LASSO = 0.5
STEP = 0.2
LEAST_DOCS = 4  # documents of the sample that must hold a feature


@dataclass
class Model:
    """Weights by feature, the sentence offset, and the document offset."""

    weights: np.ndarray
    offset: float
    document: float
    bits: int


def _features(words: Words, bits: int) -> np.ndarray:
    """Two feature numbers a word: the word, and its beginning (none: the last number)."""
    shift = np.uint64(64 - bits)
    whole = words.hashes() >> shift
    stem = (words.hashes(STEM) ^ np.uint64(0x5555555555555555)) >> shift
    stem[words.stop - words.start <= STEM] = 0
    return np.stack([np.maximum(whole, np.uint64(1)), stem], 1).astype(np.int64)


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def fit_arrays(
    cells: np.ndarray, sentence: np.ndarray, owner: np.ndarray, label: np.ndarray, size: int
) -> tuple[np.ndarray, float, float]:
    """Maximum likelihood with an absolute and a small square penalty, so that few words
    carry the model; full-batch proximal steps, scaled by feature.

    ``cells`` are feature numbers, ``sentence`` the sentence of each, ``owner`` the
    document of each sentence. The document offset stands for labels without a reason.
    """
    w, offset, document, n = np.zeros(size), -6.0, -5.0, len(label)
    seen = np.full(size + 2, 1e-3)
    slope = np.empty(size + 2)
    for _ in range(ROUNDS):
        z = np.full(len(owner), offset)
        for k in range(0, len(cells), BLOCK):
            z += np.bincount(sentence[k : k + BLOCK], w[cells[k : k + BLOCK]], len(owner))
        total = np.bincount(owner, _softplus(z), n) + _softplus(np.float64(document))
        p = -np.expm1(-total)
        pull = np.where(label == 1, -np.minimum(np.exp(-total) / np.maximum(p, 1e-12), 50.0), 1.0)
        by_sentence = _sigmoid(z) * pull[owner]
        slope[:size] = RIDGE * w
        for k in range(0, len(cells), BLOCK):
            slope[:size] += np.bincount(cells[k : k + BLOCK], by_sentence[sentence[k : k + BLOCK]], size)
        slope[size] = by_sentence.sum()
        slope[size + 1] = _sigmoid(np.float64(document)) * pull.sum()
        seen = np.maximum(0.97 * seen, slope * slope)
        rate = STEP / np.sqrt(seen)
        moved = w - rate[:size] * slope[:size]
        w = np.sign(moved) * np.maximum(np.abs(moved) - rate[:size] * LASSO, 0)
        offset -= rate[size] * slope[size]
        document -= rate[size + 1] * slope[size + 1]
        w[0] = 0
    return w, offset, document


def _fit(bits: int, most_bytes: int) -> Callable:
    def fit(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, sentences, owners, labels, n, read = [], [], [], [], 0, 0
        docs = np.zeros(1 << bits, np.int64)
        for batch in (whole.slice(k, 256) for whole in tables for k in range(0, whole.num_rows, 256)):
            if labels and read > most_bytes:
                continue
            texts, marks = batch.column("text").to_pylist(), batch.column("toxic").to_pylist()
            for a, b, words in pieces(texts):
                read += len(words.data)
                if labels and read > most_bytes:
                    break
                got, at = np.unique(words.sentence, return_index=True)
                found = _features(words, bits)
                held = np.unique(words.doc[:, None] << bits | found)
                docs += np.bincount(held & ((1 << bits) - 1), minlength=1 << bits)
                cells.append(found.astype(np.int32))
                sentences.append((np.searchsorted(got, words.sentence) + n).astype(np.int32))
                owners.append(words.doc[at] + len(labels))
                labels += marks[a:b]
                n += len(got)
        if not labels:
            return
        # A feature that next to no document holds says nothing about others.
        docs[0] = LEAST_DOCS
        names = np.flatnonzero(docs >= LEAST_DOCS)
        number = np.zeros(1 << bits, np.int32)
        number[names] = np.arange(len(names))
        cell = np.concatenate([number[c].ravel() for c in cells])
        sentence = np.concatenate([np.repeat(s, 2) for s in sentences])
        cells.clear(), sentences.clear()
        used = cell > 0
        w, offset, document = fit_arrays(
            cell[used], sentence[used], np.concatenate(owners), np.array(labels), len(names)
        )
        keep = np.flatnonzero(np.abs(w) > 1e-3)
        yield pa.record_batch(
            {
                "feature": pa.array(np.concatenate([names[keep], [-1, -2]]), pa.int64()),
                "weight": pa.array(np.concatenate([w[keep], [offset, document]]), pa.float64()),
            }
        )

    return fit


def fit(
    docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES,
    bits: int = BITS,
) -> Model:
    """Fit on labelled documents: ``docs(doc_id, text)``, ``labels(doc_id, toxic)``.

    At most ``sample_docs`` of each class and ``sample_bytes`` of text are read, in the
    order of a hash, by one task, and of equal rows one; a corpus with fewer labels is
    used whole. The model (2^bits weights at most) is what comes to the driver.
    """
    marks = labels.where("toxic in (0, 1) and doc_id is not null").select("doc_id", F.col("toxic").cast("int"))
    chosen = None
    for mark in (1, 0):
        some = marks.where(F.col("toxic") == mark).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)
        chosen = some if chosen is None else chosen.unionByName(some)
    # At most 2 * sample_docs rows of ids are broadcast, whatever the size of the labels.
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select(
        "text", "toxic", F.xxhash64("doc_id", "text").alias("h")
    )
    one = rows.dropDuplicates(["h", "toxic"]).repartition(1).sortWithinPartitions("h", "toxic").select("text", "toxic")
    with rows_per_batch(docs.sparkSession, TEXTS):
        found = one.mapInArrow(_fit(bits, sample_bytes), "feature long, weight double").toArrow()
    names, values = found.column("feature").to_numpy(), found.column("weight").to_numpy()
    weights = np.zeros(1 << bits, np.float32)
    weights[names[names > 0]] = values[names > 0]
    # Without any label nothing is toxic.
    offset, document = (values[names == k].min(initial=0.0) or UNTAUGHT for k in (-1, -2))
    return Model(weights, float(offset), float(document), bits)


def _logits(words: Words, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """First word of every sentence, and the sentence's log odds."""
    if not len(words.start):
        return np.zeros(0, np.int64), np.zeros(0)
    each = model.weights[_features(words, model.bits)].sum(1, dtype=np.float64)
    at = np.flatnonzero(np.diff(words.sentence, prepend=-1))
    return at, np.add.reduceat(each, at) + model.offset


def score(model: Model, text: Column) -> Column:
    """Probability, between 0 and 1, that the document is toxic."""

    def scores(texts: pa.Array) -> pa.Array:
        out = np.empty(len(texts))
        for base in range(0, len(texts), TEXTS):
            for a, b, words in pieces(texts[base : base + TEXTS].to_pylist()):
                at, z = _logits(words, model)
                total = np.bincount(words.doc[at], _softplus(z), b - a) + _softplus(np.float64(model.document))
                out[base + a : base + b] = -np.expm1(-total)
        return pa.array(np.clip(out, 0.0, 1.0))

    return F.arrow_udf(scores, "double")(text)


def offending(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """``doc_id, start, stop, sentence, probability`` of sentences at or above ``least``;
    code points from 0, the end exclusive."""
    kind = "array<struct<start: int, stop: int, probability: double>>"

    def find(texts: pa.Array) -> pa.Array:
        out: list[list[dict]] = [[] for _ in texts]
        for a, _, words in pieces(texts.to_pylist()):
            at, z = _logits(words, model)
            last = np.append(at[1:], len(words.start)) - 1
            p = _sigmoid(z)
            points = np.cumsum((words.data & 0xC0) != 0x80) if (p >= least).any() else None
            for k in np.flatnonzero(p >= least):
                doc = words.doc[at[k]]
                base = points[words.first[doc]]
                out[a + doc].append(
                    {
                        "start": int(points[words.start[at[k]]] - base),
                        "stop": int(points[words.stop[last[k]] - 1] - base + 1),
                        "probability": float(p[k]),
                    }
                )
        return pa.array(out, pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("probability", pa.float64())])))

    found = docs.select("doc_id", "text", F.arrow_udf(find, kind)("text").alias("hits"))
    hit = found.select("doc_id", "text", F.explode("hits").alias("hit"))
    return hit.select(
        "doc_id", "hit.start", "hit.stop",
        F.substr("text", F.col("hit.start") + 1, F.col("hit.stop") - F.col("hit.start")).alias("sentence"),
        "hit.probability",
    )


def held_out() -> Column:
    """One document in three by its id; never used to learn from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learned(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from the rows that are not held out."""
    return fit(docs, labels.where(~held_out()))
