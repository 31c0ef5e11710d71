import hashlib
import random
import re
import string
from collections import Counter, defaultdict

import pytest
import xxhash
from conftest_data import TEXTS

from dateline.llm import exact, lines, simhash

LAST = 1 << 60  # rows without an id come last


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


@pytest.mark.parametrize("size", [1, 3, 4096])
def test_exact_names_are_the_texts(messy, size):
    got = exact.duplicates(messy, size).collect()
    groups = defaultdict(list)
    for i, text in TEXTS:
        groups[norm(text)].append(LAST if i is None else i)
    want = Counter(
        (None if i is None else i, None if min(groups[norm(t)]) == LAST else min(groups[norm(t)]), len(groups[norm(t)]),
         hashlib.sha256(norm(t).encode()).hexdigest())
        for i, t in TEXTS
    )
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == want
    kept = Counter(r["text_sha256"] for r in got if r["kept"])
    assert set(kept.values()) == {1} and len(kept) == len(groups)
    assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])


def test_nothing_to_name(nothing):
    assert exact.duplicates(nothing).collect() == []
    assert lines.drop_shared_lines(nothing).collect() == []
    assert simhash.with_components(nothing).collect() == []
    assert simhash.one_of_each(nothing).collect() == []


def key(line):
    return line.strip(" \t\n\x0b\f\r").translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))


def cleaned(texts, least=10, most=1):
    holders = defaultdict(set)
    for i, text in texts:
        for line in (text or "").split("\n"):
            if len(key(line)) >= least:
                holders[key(line)].add(LAST if i is None else i)
    out = []
    for i, text in texts:
        kept, gone = [], 0
        for line in (text or "").split("\n"):
            h = holders.get(key(line), ())
            if len(h) > most and min(h) != (LAST if i is None else i):
                gone += 1
            else:
                kept.append(line)
        out.append((i, "\n".join(kept), len((text or "").split("\n")), gone))
    return Counter(out)


@pytest.mark.parametrize("most", [1, 2])
def test_shared_lines(messy, most):
    got = lines.drop_shared_lines(messy, most=most)
    assert got.columns == [*messy.columns, "n_lines", "n_dropped"]
    assert Counter((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in got.collect()) == cleaned(TEXTS, most=most)
    assert {r["_id"] for r in got.collect()} == {"x"}


def plain_print(text, k=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    rows = [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in rows]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near(one, other):
    return (one ^ other).bit_count() <= 2


def shingles(text, k=5):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + k]) for i in range(max(len(words) - k + 1, 1))} if words else set()


def alike(one, other):
    """Sets of five-word shingles, as the pipeline's stage links them."""
    shared = len(one & other)
    return shared >= 0.8 * (len(one) + len(other) - shared)


def alike_pairs(sets):
    """All pairs at least 0.8 alike: those that share one of the rarest fifth of their shingles."""
    often = Counter(x for s in sets for x in s)
    held, found = defaultdict(list), set()
    for i, s in enumerate(sets):
        rarest = sorted(s, key=lambda x: (often[x], x))[: len(s) - -(-4 * len(s) // 5) + 1]
        for j in {j for x in rarest for j in held[x]}:
            if alike(s, sets[j]):
                found.add((j, i))
        for x in rarest:
            held[x].append(i)
    return found


def components(points, linked=near):
    root = {i: i for i in range(len(points))}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(points)):
        for j in range(i):
            if linked(points[i], points[j]):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(points))]


def test_fingerprints_and_components(messy, monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", 50)
    prints = [plain_print(t) for _, t in TEXTS]
    assert [simhash.fingerprint_of(t) for _, t in TEXTS] == prints
    of = components(prints)
    least = {c: min((LAST if TEXTS[i][0] is None else TEXTS[i][0]) for i in range(len(of)) if of[i] == c) for c in of}
    want = Counter((i, f"{p:016x}", None if least[c] == LAST else least[c]) for (i, _), p, c in zip(TEXTS, prints, of))
    got = simhash.with_components(messy).select("doc_id", simhash.hexadecimal(simhash.F.col("fp")).alias("f"), "component_id")
    assert Counter(map(tuple, got.collect())) == want
    of = components([shingles(t) for _, t in TEXTS], alike)
    least = {c: min((LAST if TEXTS[i][0] is None else TEXTS[i][0]) for i in range(len(of)) if of[i] == c) for c in of}
    kept = simhash.one_of_each(messy)
    assert kept.columns == messy.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(None if v == LAST else v for v in least.values())


def test_sketches(monkeypatch):
    whole = [simhash.sketch_of(t) for _, t in TEXTS]
    for (_, text), (size, proof, keys) in zip(TEXTS, whole):
        words = len((text or "").split())
        assert size == len(shingles(text)) if words >= 5 else size == max(words - 2, min(words, 1))
        assert len(proof) == simhash.PROOF and len(keys) == simhash.BANDS
    monkeypatch.setattr(simhash, "CHUNK", 50)
    for (_, text), want in zip(TEXTS, whole):
        got = simhash.sketch_of(text)
        assert got[0] == want[0] and (got[1] == want[1]).all() and (got[2] == want[2]).all()


def test_sketches_of_pairs_as_similar_as_asked():
    """Of pairs just 0.8 alike nearly all share a key and pass the proof."""
    rng, met, passed, n = random.Random(7), 0, 0, 300
    for k in range(n):
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([60, 300]))]
        other = list(words)
        for at in range(len(words)):
            other[at] = f"x{rng.randrange(10**6)}"
            if not alike(shingles(" ".join(words)), shingles(" ".join(other))):
                other[at] = words[at]
                break
        one, two = simhash.sketch_of(" ".join(words)), simhash.sketch_of(" ".join(other))
        met += bool((one[2] == two[2]).any())
        bits = sum(int(a ^ b).bit_count() for a, b in zip(one[1], two[1]))
        passed += bits <= simhash._most_bits(0.8)
    assert met >= n - 2 and passed >= n - 2


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_no_link_of_the_given_documents_is_lost(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("doc_id", "text")
    rows = sorted(docs.collect())
    sets = [shingles(r["text"]) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in sorted(alike_pairs(sets)):
        root[max(find(i), find(j))] = min(find(i), find(j))
    want = {rows[find(i)]["doc_id"] for i in range(len(rows))}
    assert {r["doc_id"] for r in simhash.one_of_each(docs).collect()} == want and len(want) < len(rows)


def test_edited_copies_leave_and_others_stay(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    texts = []
    for family in range(12):
        base = [word() for _ in range(60 + 40 * family)]
        texts.append(" ".join(base))
        for _ in range(60 if family == 3 else 5):
            copy = list(base)
            for _ in range(rng.randint(0, len(base) // 50)):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
        texts.append(" ".join(base[: len(base) // 2] + [word() for _ in range(len(base) // 2)]))
    of = components([shingles(t) for t in texts], alike)
    assert len(set(of)) == 24
    kept = {r["doc_id"] for r in simhash.one_of_each(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert kept == set(of)


def test_links_against_all_pairs(spark):
    base = [int(hashlib.sha256(bytes([k])).hexdigest()[:16], 16) for k in range(12)]
    points = set(base)
    for k, b in enumerate(base):
        for i in range(0, 64, 5):
            points |= {b ^ 1 << i, b ^ 1 << i ^ 1 << (i * 7 + k) % 64, b ^ 1 << i ^ 1 << (i + 9) % 64 ^ 1 << (i + 31) % 64}
    points = sorted(points)
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in points]
    got = simhash.links(spark.createDataFrame(signed, "fp long")).distinct().collect()
    want = {
        tuple(sorted((signed[i][0], signed[j][0])))
        for i in range(len(points)) for j in range(i) if (points[i] ^ points[j]).bit_count() <= 2
    }
    assert {(r["a"], r["b"]) for r in got} == want


def test_chain_is_one_component(spark):
    edges = [(k, k + 1) for k in range(200)] + [(500, 501)]
    got = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(201)}, 500: 500, 501: 500}


def test_unlike_texts_of_one_filler_stay(spark):
    own = lambda k: " ".join(f"own{k}x{i}" for i in range(40))
    texts = [own(k) + " zero" * 60 for k in range(4)] + [own(0) + " zero" * 60]
    assert len({simhash.fingerprint_of(t) for t in texts}) == 1
    assert len(shingles(texts[0]) & shingles(texts[1])) < 5
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r["doc_id"] for r in simhash.one_of_each(docs).collect()) == [0, 1, 2, 3]


def test_repeated_passage_is_a_near_copy(spark):
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(words), " ".join(words + words[100:130] * 30), " ".join(f"other{i}" for i in range(300))]
    assert len(shingles(texts[0]) & shingles(texts[1])) > 0.9 * len(shingles(texts[1]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r["doc_id"] for r in simhash.one_of_each(docs).collect()) == [0, 2]


def test_copies_around_a_base_join_it(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    base = [word() for _ in range(250)]
    copies = []
    for _ in range(50):
        copy = list(base)
        for at in rng.sample(range(250), 5):
            copy[at] = word()
        copies.append(" ".join(copy))
    own = lambda k: " ".join(f"own{k}x{i}" for i in range(40)) + " zero" * 60
    texts = [*copies[:40], " ".join(base), *copies[40:], own(0), own(1), own(1) + " zero" * 10]
    of = components([shingles(t) for t in texts], alike)
    want = set(of)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    kept = {r["doc_id"] for r in simhash.one_of_each(docs).collect()}
    assert kept == want and {51, 52} <= kept and 53 not in kept


def test_near_copies_are_found_by_their_fingerprints(spark):
    """Links of fingerprints are candidates of their own: here no two texts share a key."""
    words = [f"w{i}" for i in range(400)]
    apart = lambda one, other: int(simhash.sketch_of(one)[1][0] ^ simhash.sketch_of(other)[1][0]).bit_count()
    base = " ".join(words)
    ended = [t for t in (f"{base} end{i}" for i in range(200)) if 1 <= apart(base, t) <= simhash.BITS_APART]
    texts = [base, ended[0], "  ".join(words), ended[1], " ".join(f"x{i}" for i in range(400))]
    proofs = [simhash.sketch_of(t) for t in texts]
    nodes = [(k, size, [int(x) for x in proof.view("int64")], [k]) for k, (size, proof, _) in enumerate(proofs)]
    # The last node has the first one's fingerprint but an unlike text, so it stays apart.
    nodes.append((5, 396, nodes[0][2], [5]))
    table = spark.createDataFrame(nodes, "node long, size long, proof array<long>, keys array<long>")
    rows = [*enumerate(texts), (5, " ".join(f"y{i}" for i in range(400)))]
    roots = simhash.similar(table, spark.createDataFrame(rows, "row long, text string"))
    assert {r["node"]: r["root"] for r in roots.collect()} == {0: 0, 1: 0, 2: 0, 3: 0, 4: 4, 5: 5}
