"""Phrases, voting rules and conversation prefixes against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from conftest_data import TEXTS, sentence

from dateline.llm import phrases, prefixes, queries, rules

SF = "/root/testdata/sf0.001"
CONVERSATION = "conv_id long, turn long, role string, text string, node string, keys string, first long, base long"


# Phrases.


def plain_phrases(rows, least, longest=5, top=2000, inside=100):
    counts, total = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", lowered):
            words = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            total[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    counts[lang][tuple(words[i : i + k])] += 1
    out = []
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        longer = Counter()
        for p, a in found.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    longer[p[i : i + m]] = max(longer[p[i : i + m]], a)
        rated = []
        for p, a in found.items():
            if longer[p] and 100 * longer[p] >= inside * a:
                continue
            cuts = [(1000 * a * total[lang] // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p))]
            score, _, left, right = min(cuts)
            rated.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(rated)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, total[lang], -score))
    return sorted(out)


def phrase_rows():
    draw = random.Random(5)
    words = "aa bb cc dd ee ff É東 gg hh".split()
    texts = []
    for i in range(160):
        body = "".join(draw.choice(words) + draw.choice([" ", " ", "  ", "\t", ", ", "\n", ". "]) for _ in range(60))
        texts.append((draw.choice(["en", "en", "en", "de", None, "und"]), body + "New York City " * draw.randrange(3)))
    texts += [("fr", None), ("fr", ""), ("fr", " .,;"), ("en", "x y " * 4000), ("en", "x y " * 4000), ("one", "only")]
    return texts


def phrase_table(spark, rows):
    schema = "lang string, text string, key string, word string, n string, a string, id string"
    return spark.createDataFrame([(lang, text, "k", "w", "n", "a", "i") for lang, text in rows], schema).repartition(3)


def found_phrases(docs, least, **more):
    return sorted(tuple(r) for r in phrases.collocations(docs, least, **more).collect())


@pytest.mark.parametrize("least", [2, 6, 30])
def test_phrases_are_those_of_plain_counting(spark, least):
    rows = phrase_rows()
    want = plain_phrases(rows, least)
    assert found_phrases(phrase_table(spark, rows), least) == want and want


def test_several_tries_give_the_same_phrases(spark, monkeypatch):
    rows = phrase_rows()
    docs = phrase_table(spark, rows)
    monkeypatch.setattr(phrases, "SHARD", 40)
    assert found_phrases(docs, 10) == plain_phrases(rows, 10)


def test_first_phrases_of_a_language_and_containment(spark):
    rows = phrase_rows()
    docs = phrase_table(spark, rows)
    assert found_phrases(docs, 6, top=7, inside=60) == plain_phrases(rows, 6, top=7, inside=60)
    # A phrase that occurs only inside a longer one goes with it.
    kept = {r[2] for r in found_phrases(phrase_table(spark, [("en", "new york city. " * 50)]), 5)}
    assert kept == {"new york city"}


def test_no_phrases(spark):
    docs = phrase_table(spark, phrase_rows())
    assert phrases.collocations(docs.limit(0)).collect() == []
    assert phrases.collocations(docs, least=10**6).collect() == []
    assert phrases.collocations(phrase_table(spark, [(None, None), ("x", "")]), least=1).collect() == []


def test_exact_scores_beyond_64_bits(spark):
    row = spark.sql("select 9000000000000 a, 9000000000000 n, 3000000000 l, 7000000000 r").selectExpr(
        "(cast(1000 as decimal(4,0)) * cast(a as decimal(17,0)) * cast(n as decimal(17,0)))"
        " div (cast(l as decimal(19,0)) * cast(r as decimal(19,0))) as score"
    )
    assert row.first()["score"] == 1000 * 9000000000000**2 // (3000000000 * 7000000000)


def test_ids_that_collide_are_drawn_anew():
    codes, words, names, n = phrases._encoded(b"b a.a  c\td,a\n", 7)
    assert [w.decode() for w in words] == ["b", "a", "c", "d"] and list(n) == [1, 3, 1, 1]
    assert list(codes) == [1, 2, 0, 2, 3, 4, 0, 2] and len(set(names)) == 4
    assert list(phrases._encoded(b"b a", 8)[2]) != list(phrases._encoded(b"b a", 7)[2])
    assert [len(v) for v in phrases._encoded(b" .\n", 1)] == [0, 0, 0, 0]


def test_long_texts_are_cut_at_punctuation_only(monkeypatch):
    monkeypatch.setattr(phrases, "CHUNK", 16)
    data = b"one two three four five six, seven eight. nine " + b"z" * 40 + b" ten; eleven"
    slices = list(phrases._slices(data))
    assert len(slices) > 2
    parts = [p.split() for s in slices for p in re.split(rb"[.,;]", s)]
    assert [p for p in parts if p] == [p.split() for p in re.split(rb"[.,;]", data)]


def test_double_array_accepts_its_phrases_and_no_others():
    draw = random.Random(3)
    ids = [draw.getrandbits(63) - (1 << 62) for _ in range(700)]
    made = {(draw.choice("de"), tuple(draw.choice(ids[:: draw.choice([1, 50])]) for _ in range(draw.randint(1, 4)))) for _ in range(6000)}
    made = sorted(made)
    trie = phrases.double_array([lang for lang, _ in made], [b"".join(i.to_bytes(8, "big", signed=True) for i in p) for _, p in made])
    assert trie.digits == 2
    number = {p: k for k, p in enumerate(made)}
    text = np.array([draw.choice(ids + [0, 5]) for _ in range(4000)] + [i for _, p in made[:500] for i in (*p, 0)])
    coded = np.unique(text, return_inverse=True)
    coded = coded[0], coded[1].ravel() + 1
    for lang in "de":
        got = {}
        for level, (places, states) in enumerate(trie.levels(trie.roots[lang], *trie.symbols(*coded), 4), 1):
            got |= {(int(p), level): int(trie.phrase[s]) for p, s in zip(places, states) if trie.phrase[s] >= 0}
        want = {
            (at, k): number[lang, tuple(text[at : at + k].tolist())]
            for at in range(len(text)) for k in range(1, 5)
            if at + k <= len(text) and (lang, tuple(text[at : at + k].tolist())) in number
        }
        assert got == want and want
    used = trie.check[trie.check >= 0]
    assert len(used) == len({(s, n) for n, s in enumerate(trie.check.tolist()) if s >= 0})


def test_a_row_without_any_break(spark):
    text = "alpha beta gamma " * 120_000  # 2 MB without punctuation
    got = found_phrases(phrase_table(spark, [("en", text)]), 1000)
    assert got == plain_phrases([("en", text)], 1000)


# Rules.


def plain_measures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)
    )


def test_measures_are_those_of_plain_counting(spark, messy):
    got = Counter((r["doc_id"], *[r[m] for m in rules.MEASURES[:5]]) for r in rules.measured(messy).collect())
    assert got == Counter((i, *plain_measures(t)) for i, t in TEXTS)


def test_measures_of_random_texts():
    draw = random.Random(11)
    texts = [
        "".join(draw.choice("ab #$\n\x0b\x0c\té東.A1") for _ in range(draw.choice([0, 1, 5, 60, 400]))) for _ in range(400)
    ] + [" ".join(draw.choice(["a", "b"]) for _ in range(50)) for _ in range(50)] + [sentence(2) + "\n" + sentence(2)]
    found = rules._measures(texts)
    assert [tuple(r[:5]) for r in found.tolist()] == [plain_measures(t) for t in texts]
    for r, t in zip(found.tolist(), texts):
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        stops = {f for w in rules.STOP_WORDS for f in (w, w.capitalize(), w.upper())}
        assert r[5:] == [
            len(t.split("\n")), len(set(words)), sum(w in stops for w in words), len(re.findall("[.!?]", t)),
            len(re.findall("[0-9]", t)), len(re.findall("[A-Z]", t)),
        ]


def test_windows_are_named_exactly_when_the_numbers_are_large():
    draw = np.random.default_rng(1)
    columns = [draw.integers(0, 1 << 24, 3000) for _ in range(5)]
    columns = [np.concatenate([c, c[:100]]) for c in columns]
    names = rules._named(*columns)
    rows = list(zip(*[c.tolist() for c in columns]))
    assert len(set(zip(names.tolist(), rows))) == len(set(names.tolist())) == len(set(rows))


def plain_maximised(votes):
    """Expectation maximisation document by document."""
    n, m = len(votes), len(votes[0])
    believed = rules.believed(m).tolist()
    prior, given = rules.PRIOR, believed
    for _ in range(rules.ROUNDS):
        good = []
        for v in votes:
            odds = [math.log(1 - prior), math.log(prior)]
            for k, vote in enumerate(v):
                for c in range(2):
                    odds[c] += math.log(given[k][c][vote + 1])
            good.append(1 / (1 + math.exp(odds[0] - odds[1])))
        fresh = [[[rules.TRUST * n * believed[k][c][x] for x in range(3)] for c in range(2)] for k in range(m)]
        for v, g in zip(votes, good):
            for k, vote in enumerate(v):
                fresh[k][0][vote + 1] += 1 - g
                fresh[k][1][vote + 1] += g
        fresh = [[[x / sum(row) for x in row] for row in rule] for rule in fresh]
        prior = min(max(sum(good) / n, 0.01), 0.99)
        moved = max(abs(fresh[k][c][x] - given[k][c][x]) for k in range(m) for c in range(2) for x in range(3))
        given = fresh
        if moved < 1e-9:
            break
    odds = []
    for v in votes:
        odds.append(math.log(prior / (1 - prior)) + sum(math.log(given[k][1][x + 1] / given[k][0][x + 1]) for k, x in enumerate(v)))
    return [1 / (1 + math.exp(-o)) for o in odds]


def test_verdicts_are_those_of_a_plain_maximisation(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = rules.judged(docs).collect()
    want = plain_maximised([[r[name] for name in rules.RULES] for r in rows])
    assert [r["posterior"] for r in rows] == pytest.approx(want, abs=1e-6)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    thin = queries.op12_quality_rules(spark, SF).collect()
    assert len(thin) == len(texts)
    posterior = {r["doc_id"]: p for r, p in zip(rows, want)}
    for r in thin:
        n, chars, symbols, lines, repeated = plain_measures(texts[r["doc_id"]])
        failed = n < 10 or 100 * repeated > 20 * n
        assert tuple(r)[:7] == (r["doc_id"], n, chars, symbols, lines, repeated, failed)
        assert r["kept"] == (not failed and posterior[r["doc_id"]] >= 0.5)


def test_labels_agree_with_verdicts(spark):
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet").where("quality is not null")
    rows = queries.op12_quality_rules(spark, folder).where("not base_failed").join(labels, "doc_id").collect()
    good, bad = ([r["kept"] for r in rows if r["quality"] == q] for q in (1, 0))
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.1


def test_rules_find_who_is_right():
    """Rules of known accuracy: the maximisation finds it, and weighs them by it."""
    draw = np.random.default_rng(4)
    n, right = 20_000, [0.95, 0.9, 0.85, 0.8, 0.75, 0.7, 0.9, 0.9, 0.6, 0.9]
    truth = draw.random(n) < 0.7
    votes = np.where(draw.random((n, 10)) < right, truth[:, None], ~truth[:, None]) * 2 - 1
    votes[draw.random((n, 10)) < 0.3] = 0
    patterns, inverse, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    model = rules.maximised(patterns, counts.astype(float))
    assert list(model.accuracies().values()) == pytest.approx(right, abs=0.05)
    assert ((model.posterior(patterns)[inverse.ravel()] >= 0.5) == truth).mean() > 0.97
    assert rules.maximised(patterns[:0], counts[:0].astype(float)).prior == rules.PRIOR


def test_rules_on_hard_rows(spark, messy, nothing):
    rows = rules.judged(messy).collect()
    assert len(rows) == len(TEXTS)
    assert all(r["base_failed"] and not r["kept"] for r in rows if r["n_words"] < 10)
    assert rules.judged(nothing).collect() == []


# Prefixes.


def plain_nodes(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            key = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()[:32]
            turns[conv].append((turn is not None, turn or 0, key, role, text))
    own = {c: [(r, t) for *_, r, t in sorted(some)] for c, some in turns.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100 if c >= 0 else -(abs(c) % 100))
        built[c] = tuple(own.get(base, [])[:h] + own[c][h:])
    members = defaultdict(list)
    for c, path in built.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    out = []
    for node, some in members.items():
        inside = [m for m in members if m[: len(node)] == node]
        childless = [m for m in inside if not any(len(x) == len(m) + 1 and x[:-1] == m for x in members)]
        ends = sorted(c for c in some if built[c] == node)
        out.append((
            min(some), len(node), min(members[node[:-1]]) if node else None, len(some),
            sum(len(m) == len(node) + 1 and m[:-1] == node for m in members), len(childless),
            sum((len(members[m]) - 1) * len(m[-1][1]) for m in inside if m),
            hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        ))
    return Counter(out)


def conversations(seed, n=70):
    draw = random.Random(seed)
    rows = []
    for c in draw.sample([*range(0, 40), *range(95, 140), *range(200, 212), -3, -100, -101, 12345678901], n):
        for turn in draw.sample([None, 0, 1, 2, 3, 4, 5, 6, 7, 8, 9], draw.randrange(1, 10)):
            text = draw.choice(["yes", "no", "é東", "", None, "long " * 20])
            rows.append((c, turn, draw.choice(["user", "user", None, ""]), text))
    rows += [(None, 1, "user", "nobody"), (7, 3, "user", "tie"), (7, 3, "bot", "tie"), (7, 3, "bot", "tie")]
    return rows


def nodes_of(spark, rows):
    table = spark.createDataFrame([(*r, "n", "k", 5, 6) for r in rows], CONVERSATION).repartition(3)
    return Counter(tuple(r) for r in prefixes.prefix_nodes(table).drop("node").collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_nodes_are_those_of_plain_prefixes(spark, seed):
    rows = conversations(seed)
    assert nodes_of(spark, rows) == plain_nodes(rows)


def test_nodes_of_copies_and_of_one_long_conversation(spark):
    rows = [(c, t, "user", f"turn {t}") for c in range(300, 360) for t in range(4)]
    rows += [(c, t, "user", f"turn {t % 3}") for c in (400, 401, 499) for t in range(90)]
    assert nodes_of(spark, rows) == plain_nodes(rows)


def test_no_nodes(spark):
    empty = spark.createDataFrame([], CONVERSATION)
    assert prefixes.prefix_nodes(empty).collect() == []
    assert nodes_of(spark, [(None, None, None, None)]) == Counter()
    assert nodes_of(spark, [(3, None, None, None)]) == plain_nodes([(3, None, None, None)])


def test_prefix_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{SF}/conversations.parquet'")
    result = con.execute(queries.SQL["op13_prefix_trie"])
    got = queries.op13_prefix_trie(spark, SF)
    assert got.columns == [c[0] for c in result.description]
    assert Counter(tuple(r) for r in got.collect()) == Counter(result.fetchall())


def test_two_fattest():
    for low in range(40):
        for high in range(low + 1, 41):
            want = max(range(low + 1, high + 1), key=lambda f: f & -f)
            assert prefixes.two_fattest(low, high) == want


def test_fat_search_finds_the_exit_and_few_lookups(monkeypatch):
    draw = random.Random(9)
    pool = [[draw.choice("ab") for _ in range(draw.choice([3, 20, 200]))] for _ in range(60)]
    pool += [p[: draw.randrange(len(p))] + [draw.choice("abc")] * draw.randrange(9) for p in pool for _ in range(4)]

    def path(turns):
        return prefixes._paths({"keys": [None, *[t.encode() for t in turns]], "chars": [0] * (len(turns) + 1), "conv_id": 1})

    trie, known = prefixes.ZFastTrie(), set()
    for at in range(0, len(pool), 37):
        for turns in pool[at : at + 37]:
            p = path(turns)
            lookups = []

            class Watched(dict):
                def get(self, key):
                    lookups.append(key)
                    return dict.get(self, key)

            held, trie.handles = trie.handles, Watched(trie.handles)
            node, leaving, depth = trie.exit(p)
            trie.handles = held
            shared = max((d for d in range(len(p.names)) if p.names[d] in known), default=0)
            assert depth == shared and len(lookups) <= 2 * len(p.names).bit_length() + 1
            assert node.path.names[node.depth] == p.names[node.depth]
        trie.insert([path(turns) for turns in pool[at : at + 37]])
        known |= {n for turns in pool[at : at + 37] for n in path(turns).names}
    assert len(trie.handles) == len(trie.nodes) - 1 == len(trie.below)
    assert {r["node"] for r in prefixes.members(trie)} == known
    # Only branching and ending nodes are kept.
    children = Counter(id(n.parent) for n in trie.nodes)
    assert all(children[id(n)] > 1 or n.ends for n in trie.nodes if n.parent)


def test_tries_begun_anew_add_up(monkeypatch):
    draw = random.Random(2)
    rows = [
        {"conv_id": c, "keys": [None, *[draw.choice([b"x", b"y"]) for _ in range(draw.randrange(30))]]} for c in range(300)
    ]
    for r in rows:
        r["chars"] = [0] + [len(r["keys"])] * (len(r["keys"]) - 1)
    kinds = pa.schema([("conv_id", pa.int64()), ("keys", pa.list_(pa.binary())), ("chars", pa.list_(pa.int64()))])

    def added():
        total = defaultdict(lambda: [0, 1 << 62, []])
        for batch in prefixes.expand_members(iter([pa.RecordBatch.from_pylist(rows, kinds)])):
            for r in batch.to_pylist():
                mine = total[r["node"], r["parent"], r["depth"]]
                mine[0], mine[1] = mine[0] + r["n"], min(mine[1], r["first"])
                mine[2] = sorted(mine[2] + r["ends"])
        return dict(total)

    whole = added()
    monkeypatch.setattr(prefixes, "HELD", 200)
    monkeypatch.setattr(prefixes, "BATCH", 7)
    assert added() == whole and sum(len(v[2]) for v in whole.values()) == 300


def test_ends_are_hashed_in_blocks(spark):
    ids = [*range(-5000, 9000, 2), 1 << 40]
    ends = spark.createDataFrame([(b"n", i) for i in ids] + [(b"m", 7)], "node binary, conv_id long").repartition(3)
    got = {bytes(r["node"]): r["ends_sha256"] for r in prefixes.end_digests(ends).collect()}
    assert got == {
        b"n": hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), b"m": hashlib.sha256(b"7").hexdigest()
    }
