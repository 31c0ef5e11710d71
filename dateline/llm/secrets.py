"""Secrets in texts through a trigram index, with DataFrame functions only.

From every rule's regular expression a Boolean query on trigrams is derived: an OR of
ANDs of trigrams that a match must contain, in lower case. The index holds, for the
trigrams of the queries, the texts they occur in; intersecting postings gives each
rule's candidates, and only these are searched with the expression. A rule without
mandatory trigrams is searched for in every text.

A rule's matches are leftmost and do not overlap. Where they lie follows from the
lengths of the matches and of what is between them, in code points. Work per text is
that of the expressions, plus copies of references, as many as its number of matches
times the root of that number.

Null counts as empty. Rows of equal id and text share their postings; every row gets
its result. Other columns are not used.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product
from re import _constants as op
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dateline.session import broadcast_within, cut

_MOST_STRINGS, _MOST_CLAUSES = 64, 128


@dataclass(frozen=True)
class Rule:
    """``least`` is how long ``group`` must be for a match to count."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


# The three rules of the contract, then those this operator adds.
BASE = (
    Rule(
        "assign",
        r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        6,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}"),
)
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("forge", r"gh[opsu]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abps]-[A-Za-z0-9-]{10,}"),
    Rule("web", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{5,}"),
)
RULES = BASE + MORE


def _strings(item: tuple) -> set[str] | None:
    """All strings, in lower case, that a parsed item can match, if they are few."""
    code, value = item
    if code is op.LITERAL:
        return {chr(value).lower()}
    if code is op.IN and len(value) <= 4 and all(c is op.LITERAL for c, _ in value):
        return {chr(c).lower() for _, c in value}
    if code is op.SUBPATTERN:
        return _joined(value[3])
    if code is op.BRANCH:
        found = [_joined(branch) for branch in value[1]]
        return None if None in found else set().union(*found)
    if code is op.MAX_REPEAT and value[1] <= 2:
        once = _joined(value[2])
        if once is not None:
            return {"".join(p) for n in range(value[0], value[1] + 1) for p in product(once, repeat=n)}
    return None


def _joined(items) -> set[str] | None:
    whole = {""}
    for item in items:
        part = _strings(item)
        if part is None or len(whole) * len(part) > _MOST_STRINGS:
            return None
        whole = {a + b for a in whole for b in part}
    return whole


def _needs(items) -> list[list[frozenset[str]]]:
    """What a match must contain: an AND of ORs of trigram sets."""
    needs, run = [], {""}

    def flush() -> None:
        nonlocal run
        if run and all(len(s) >= 3 for s in run):
            needs.append([frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in sorted(run)])
        run = {""}

    for item in items:
        part = _strings(item)
        if part is not None:
            if len(run) * len(part) > _MOST_STRINGS:
                flush()
            run = {a + b for a in run for b in part}
            continue
        flush()
        code, value = item
        if code is op.SUBPATTERN:
            needs += _needs(value[3])
        elif code is op.MAX_REPEAT and value[0] >= 1:
            needs += _needs(value[2])
        elif code is op.BRANCH:
            branches = [_needs(branch) for branch in value[1]]
            if all(branches):
                needs.append([clause for branch in branches for clause in _clauses(branch)])
    flush()
    return needs


def _clauses(needs: list[list[frozenset[str]]]) -> list[frozenset[str]]:
    clauses = [frozenset()]
    for need in sorted(needs, key=len):
        if len(clauses) * len(need) <= _MOST_CLAUSES:
            clauses = [a | b for a in clauses for b in need]
    return sorted({c for c in clauses if not any(other < c for other in clauses)}, key=sorted)


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """Any of these sets of trigrams must be in a text that matches; none: no such bound."""
    needs = _needs(_parser.parse(pattern))
    return _clauses(needs) if needs else []


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """``trigram, doc_id, mark``: the texts in which each trigram occurs, lower-cased."""
    low = docs.select("doc_id", F.xxhash64("text").alias("mark"), F.lower("text").alias("low"))
    held = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in trigrams]))
    return low.select(F.explode(held).alias("trigram"), "doc_id", "mark")


def candidates(index: DataFrame, queries: dict[str, list[frozenset[str]]]) -> DataFrame:
    """``doc_id, mark, kinds``: the rules whose query a text fulfils.

    Intersects the postings text by text; a text has at most one of each trigram.
    """
    wanted = sorted({t for query in queries.values() for clause in query for t in clause})
    texts = index.where(F.col("trigram").isin(wanted)).groupBy("doc_id", "mark").agg(
        F.collect_set("trigram").alias("held")
    )

    def fulfils(query: list[frozenset[str]]) -> Column:
        tests = [F.size(F.array_except(F.array(*map(F.lit, sorted(clause))), "held")) == 0 for clause in query]
        return F.exists(F.array(*tests), lambda t: t)

    kinds = F.array_compact(F.array(*[F.when(fulfils(q), F.lit(kind)) for kind, q in queries.items()]))
    return texts.select("doc_id", "mark", kinds.alias("kinds")).where(F.size("kinds") > 0)


def _running(matches: Column, least: int) -> Column:
    """Spans of the matches from their lengths and the gaps before them.

    Appending to an array copies it, so the matches go in slices of about the root of
    their number; each slice starts where the one before it ended.
    """
    none = F.expr("cast(array() as array<struct<start: int, stop: int>>)")
    width = F.greatest(F.ceil(F.sqrt(F.size(matches))), F.lit(1)).cast("int")
    last = F.ceil(F.size(matches) / width).cast("int")

    def step(held: Column, m: Column) -> Column:
        begin = held["at"] + m["gap"]
        end = begin + m["whole"]
        kept = F.concat(held["out"], F.array(F.struct(begin.alias("start"), end.alias("stop"))))
        return F.struct(end.alias("at"), F.when(m["part"] >= least, kept).otherwise(held["out"]).alias("out"))

    def next_slice(done: Column, k: Column) -> Column:
        start = F.struct(F.element_at(done, -1)["at"].alias("at"), none.alias("out"))
        return F.concat(done, F.array(F.aggregate(F.slice(matches, (k - 1) * width + 1, width), start, step)))

    nothing = F.struct(F.lit(0).alias("at"), none.alias("out"))
    slices = F.aggregate(F.sequence(F.lit(1), last), F.array(nothing), next_slice)
    return F.when(last > 0, F.flatten(F.transform(slices, lambda s: s["out"]))).otherwise(none)


def _spans(rule: Rule) -> Column:
    """Matches of one rule in ``text`` as ``array<struct<start, stop>>``."""
    text, pattern = F.col("text"), F.lit(rule.pattern)
    gaps = F.transform(F.split(text, rule.pattern, -1), F.char_length)
    whole = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), F.char_length)
    part = F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), F.char_length) if rule.group else whole
    matches = F.arrays_zip(whole.alias("whole"), part.alias("part"), F.slice(gaps, F.lit(1), F.size(whole)).alias("gap"))
    # As an element of an array the matches are found once, not again for every slice.
    return F.transform(F.array(matches), lambda m: _running(m, rule.least))[0]


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``doc_id, spans``: every row's ``array<struct<start, place, kind, stop>>``, in order
    of start and then of the rules. Runs jobs that write the postings and candidates."""
    queries = {rule.kind: trigram_query(rule.pattern) for rule in rules}
    bound = {kind: query for kind, query in queries.items() if query}
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    index = cut(postings(texts, sorted({t for q in bound.values() for c in q for t in c})), "postings")
    hits = cut(candidates(index, bound), "candidates").toDF("_id", "_of", "kinds")
    met = texts.withColumn("_mark", F.xxhash64("text")).join(
        broadcast_within(hits, F.size("kinds") * 16 + 48),
        F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_mark") == F.col("_of")),
        "left",
    )
    none = F.expr("cast(array() as array<struct<start: int, stop: int>>)")
    staged = met.select(
        "doc_id",
        *[
            (F.when(F.array_contains("kinds", rule.kind), _spans(rule)).otherwise(none) if queries[rule.kind] else _spans(rule))
            .alias(rule.kind)
            for rule in rules
        ],
    )

    def labelled(place: int, kind: str) -> Column:
        return F.transform(
            kind, lambda s: F.struct(s["start"], F.lit(place).alias("place"), F.lit(kind).alias("kind"), s["stop"])
        )

    spans = F.sort_array(F.concat(*[labelled(i, rule.kind) for i, rule in enumerate(rules)]))
    return staged.select("doc_id", spans.alias("spans"))


def spelled(spans: Column) -> Column:
    """``kind:start:stop`` of every span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
