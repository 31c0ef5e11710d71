"""Quality rules that vote, weighed by how reliable they turn out to be.

A filter that demands every rule drops what one bad rule dislikes. Here each rule votes
good, bad or abstains on each document, and expectation maximisation over all documents
estimates, without labels, how often each rule is right. A document is kept when its
posterior probability of being good is at least ``KEEP``; two hard limits, on too few words
and on repeated passages, still reject outright.

1. One pass over the whole texts measures them (``measured``), in numpy on whole texts.
   Words are runs of ``[^\\x20\\x09-\\x0D]``. Names of words and windows are exact, not hashed.
2. Votes are counted by pattern: at most 3^rules rows, however many documents, and the
   counts combine before the shuffle. The maximisation reads only these.
3. The posterior is a sum of log odds, one Column expression.

Null and empty texts have no words and are rejected by the limit on words. Rows without
``doc_id``, repeated rows and ties are judged row by row. An empty table gives an empty
result. Other columns are not read. Memory of a task follows its longest text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dateline.llm.words import PIECE
from dateline.session import cut

WINDOW = 5  # words of a window that may repeat
LEAST_WORDS = 10  # fewer are rejected
MOST_REPEATED = 20  # percent of the words in repeated windows; more are rejected
KEEP = 0.5  # posterior from which a document is kept
ROUNDS = 300
TRUST = 0.05  # weight of what is believed of a rule beforehand, as a share of all documents
PRIOR = 0.85  # share of good documents at the start

# Frequent short words of English, German, French and Spanish.
STOP_WORDS = "the and of to in is that der die das und ist nicht le la les et est que de el los en un una".split()

MEASURES = (
    "n_words word_chars n_symbols n_dup_lines n_repeat_words n_lines n_distinct n_stops n_ends n_digits n_capitals".split()
)
# What a byte is: one bit each of a table over all bytes.
_KINDS = ["blank", "point", "symbol", "end", "digit", "capital"]
_CLASS = np.zeros(256, np.uint8)
for _k, _members in enumerate(
    [
        b" \t\n\x0b\x0c\r",
        # The first bytes of code points that are no blanks.
        [b for b in range(256) if b & 0xC0 != 0x80 and b not in b" \t\n\x0b\x0c\r"],
        b"#*$%&|<>",
        b".!?",
        b"0123456789",
        b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    ]
):
    _CLASS[list(_members)] |= 1 << _k
_STOPS = pa.array([form.encode() for w in STOP_WORDS for form in {w, w.capitalize(), w.upper()}], pa.large_binary())


def _named(*columns: np.ndarray) -> np.ndarray:
    """One number per row, equal for equal rows of the columns (small non-negative numbers)."""
    key, span = np.zeros(len(columns[0]), np.int64), 1
    for column in columns:
        width = int(column.max(initial=0)) + 1
        if span * width >= 1 << 62:
            distinct, key = np.unique(key, return_inverse=True)
            span = len(distinct)
        key, span = key * width + column, span * width
    return key


def _pieces(texts: list[str]) -> Iterator[list[str]]:
    """Runs of whole texts of about ``PIECE`` characters."""
    held, size = [], 0
    for text in texts:
        if held and size + len(text) > PIECE:
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text)
    if held:
        yield held


def _repeated_lines(text: str) -> tuple[int, int]:
    """Lines in all, and lines with a word that equal an earlier one."""
    lines = text.split("\n")
    if len(lines) == 1:
        return 1, 0
    told = [line for line in lines if line.strip(" \t\x0b\x0c\r")]
    return len(lines), len(told) - len(set(told))


def _measures(texts: list[str]) -> np.ndarray:
    """``MEASURES`` of each text, as rows."""
    n = len(texts)
    coded = [t.encode("utf-8", "replace") for t in texts]
    data = np.frombuffer(b"\n".join(coded) + b"\n", np.uint8)
    sizes = np.fromiter((len(c) + 1 for c in coded), np.int64, n)
    ends = np.cumsum(sizes)
    kinds = np.take(_CLASS, data)
    inside = (kinds & 1) == 0
    edges = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0, append=0))
    start, stop = edges[::2], edges[1::2]
    doc = np.searchsorted(ends, start, "right")

    def counted(kind: str) -> np.ndarray:
        at = np.flatnonzero(kinds & (1 << _KINDS.index(kind)))
        return np.diff(np.searchsorted(at, ends), prepend=0)

    offsets = np.zeros(len(start) + 1, np.int64)
    np.cumsum(stop - start, out=offsets[1:])
    words = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(data[inside])])
    encoded = words.dictionary_encode()
    word = encoded.indices.to_numpy().astype(np.int64)
    stops = pc.is_in(encoded.dictionary, value_set=_STOPS).to_numpy(zero_copy_only=False)

    repeated = np.zeros(len(word) + 1, np.int64)
    if len(word) >= WINDOW:
        last = len(word) - WINDOW + 1
        at = np.flatnonzero(doc[:last] == doc[WINDOW - 1 :])
        names = _named(doc[at], *[word[at + k] for k in range(WINDOW)])
        _, which, often = np.unique(names, return_inverse=True, return_counts=True)
        twice = at[often[which] > 1]
        repeated[twice] += 1
        repeated[twice + WINDOW] -= 1
    covered = np.cumsum(repeated)[:-1] > 0
    own_words = np.unique(_named(doc, word), return_index=True)[1]
    lines = np.array([_repeated_lines(t) for t in texts], np.int64)
    columns = {
        "n_words": np.bincount(doc, minlength=n),
        "word_chars": counted("point"),
        "n_symbols": counted("symbol"),
        "n_dup_lines": lines[:, 1],
        "n_repeat_words": np.bincount(doc[covered], minlength=n),
        "n_lines": lines[:, 0],
        "n_distinct": np.bincount(doc[own_words], minlength=n),
        "n_stops": np.bincount(doc[stops[word]], minlength=n),
        "n_ends": counted("end"),
        "n_digits": counted("digit"),
        "n_capitals": counted("capital"),
    }
    return np.stack([columns[m] for m in MEASURES], 1)


def measured(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``MEASURES`` of every whole text."""
    kind = "struct<" + ", ".join(f"{m}: long" for m in MEASURES) + ">"

    def measure(texts: pa.Array) -> pa.Array:
        plain = [t or "" for t in texts.to_pylist()]
        found = [_measures(some) for some in _pieces(plain)] or [np.zeros((0, len(MEASURES)), np.int64)]
        rows = np.concatenate(found)
        return pa.StructArray.from_arrays([pa.array(rows[:, k], pa.int64()) for k in range(len(MEASURES))], MEASURES)

    return docs.select("doc_id", F.arrow_udf(measure, kind)("text").alias("m")).select("doc_id", "m.*")


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0).cast("tinyint")


def rules() -> dict[str, Column]:
    """Each rule's vote, from the measures: -1 bad, 0 abstains, 1 good."""
    words, no = F.col("n_words"), F.lit(False)
    some, many = words >= LEAST_WORDS, words >= 2 * LEAST_WORDS
    share = lambda name, percent: 100 * F.col(name) > percent * words
    return {
        "length": _vote(words >= 40, ~some),
        "symbols": _vote(no, some & share("n_symbols", 15)),
        "dup_lines": _vote(no, 10 * F.col("n_dup_lines") > 3 * F.col("n_lines")),
        "repeats": _vote(no, share("n_repeat_words", MOST_REPEATED)),
        "word_length": _vote(no, some & ((F.col("word_chars") < 3 * words) | (F.col("word_chars") > 12 * words))),
        "stop_words": _vote(some & share("n_stops", 10), many & ~share("n_stops", 3)),
        "sentences": _vote(some & (F.col("n_ends") > 0), (words >= 40) & (F.col("n_ends") == 0)),
        "variety": _vote(no, many & (4 * F.col("n_distinct") < words)),
        "digits": _vote(no, 10 * F.col("n_digits") > 3 * F.col("word_chars")),
        "capitals": _vote(no, some & (10 * F.col("n_capitals") > 4 * F.col("word_chars"))),
    }


RULES = "length symbols dup_lines repeats word_length stop_words sentences variety digits capitals".split()


def voted(measures: DataFrame) -> DataFrame:
    """The rows with a column per rule, named as in ``RULES``."""
    votes = rules()
    return measures.select("*", *[votes[name].alias(name) for name in RULES])


@dataclass
class RuleModel:
    """``given[k, c, v + 1]``: how often rule k votes v on documents of class c (0 bad, 1 good)."""

    prior: float
    given: np.ndarray

    def accuracies(self) -> dict[str, float]:
        """How often a rule that does not abstain is right."""
        weight = np.array([1 - self.prior, self.prior])[:, None]
        mass = self.given * weight
        right = mass[:, 0, 0] + mass[:, 1, 2]
        spoken = mass[:, :, 0].sum(1) + mass[:, :, 2].sum(1)
        return {name: float(a) for name, a in zip(RULES, right / spoken)}

    def log_odds(self) -> np.ndarray:
        """What each vote of each rule adds to the log odds of being good."""
        return np.log(self.given[:, 1] / self.given[:, 0])

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        odds = self.log_odds()[np.arange(patterns.shape[1])[None, :], patterns + 1].sum(1)
        return 1 / (1 + np.exp(-(odds + np.log(self.prior / (1 - self.prior)))))


def believed(n: int) -> np.ndarray:
    """Before any document is seen, every rule is somewhat better than chance."""
    given = np.empty((n, 2, 3))
    given[:, 0], given[:, 1] = [0.3, 0.6, 0.1], [0.01, 0.59, 0.4]
    return given


def maximised(patterns: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> RuleModel:
    """Expectation maximisation over the vote patterns and how often each occurs.

    What is believed beforehand has the weight of ``TRUST`` of all documents, which keeps
    rules that speak of one fault alone from taking over the meaning of the classes. No
    document at all leaves the beliefs as they are.
    """
    start = believed(patterns.shape[1])
    model, total = RuleModel(PRIOR, start), float(counts.sum())
    votes = (patterns[:, :, None] + 1 == np.arange(3)).astype(float)
    for _ in range(rounds if total else 0):
        good = model.posterior(patterns)
        weight = np.stack([(1 - good) * counts, good * counts])
        seen = np.einsum("cp,pkv->kcv", weight, votes) + TRUST * total * start
        fresh = RuleModel(float(np.clip(weight[1].sum() / total, 0.01, 0.99)), seen / seen.sum(2, keepdims=True))
        moved = np.abs(fresh.given - model.given).max()
        model = fresh
        if moved < 1e-9:
            break
    return model


def rule_model(votes: DataFrame) -> RuleModel:
    """Fitted to all rows of ``votes``; at most 3^rules rows come to the driver. Runs a job."""
    table = votes.groupBy(*RULES).agg(F.count("*").alias("n")).orderBy(*RULES).toArrow()
    patterns = np.stack([table.column(name).to_numpy().astype(np.int64) for name in RULES], 1)
    return maximised(patterns, table.column("n").to_numpy().astype(float))


def posterior(model: RuleModel) -> Column:
    """The probability that a row with votes is good."""
    odds = F.lit(float(np.log(model.prior / (1 - model.prior))))
    for name, (bad, none, good) in zip(RULES, model.log_odds().tolist()):
        odds = odds + F.when(F.col(name) < 0, bad).when(F.col(name) > 0, good).otherwise(none)
    return 1 / (1 + F.exp(-odds))


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def judged(docs: DataFrame) -> DataFrame:
    """One row a document: ``doc_id``, ``MEASURES``, ``RULES`` (votes), ``posterior``,
    ``base_failed`` and ``kept``. Reads the texts once; runs jobs that write the measures
    to the shared folder."""
    votes = voted(cut(measured(docs), "measures"))
    rated = votes.withColumn("posterior", posterior(rule_model(votes))).withColumn("base_failed", base_failed())
    return rated.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= KEEP))
