import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from dateline.functions.vectors import cosine, unit
from dateline.operators import neighbours as searches
from dateline.operators.clusters import central_rows, cluster_members, cluster_summary, kmeans_topics, pca_3d
from dateline.operators.embed import encoded, hashed_words, mean_pool, shape
from dateline.operators.fuzzy import fuzzy_graph, local_scale
from dateline.operators.neighbours import neighbours
from dateline.session import cut
from dateline.sources.vectors import attrs_of, points_with_text, read_store, write_store

SCHEMA = "id long, vector array<float>"


def clustered(n, dims, groups, seed):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(groups, dims)) * 3
    return (centers[rng.integers(0, groups, n)] + rng.normal(size=(n, dims)) * 0.4).astype(np.float32)


@pytest.fixture(scope="module")
def hot(spark):
    """Clusters, copies that are a third of all rows, a few pairs of copies, a zero."""
    base = clustered(600, 12, 9, 1)
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    rows += [(5000 + i, base[7].tolist()) for i in range(320)]
    rows += [(9000 + i, base[i].tolist()) for i in range(20)]
    rows.append((-5, [0.0] * 12))
    return rows, spark.createDataFrame(rows, SCHEMA).cache()


def brute_force(rows, k):
    ids = np.array([i for i, _ in rows])
    m = np.array([v for _, v in rows], dtype=float)
    keep = np.linalg.norm(m, axis=1) > 0
    ids, m = ids[keep], m[keep]
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    far = np.round(np.maximum(0, 1 - m @ m.T), 9)
    found = {}
    for i in range(len(ids)):
        row = far[i].copy()
        row[i] = -1
        found[int(ids[i])] = [int(ids[j]) for j in np.lexsort((ids, row))[:k]]
    return found


@pytest.mark.parametrize("options", [{}, {"block": 40, "pivots": 12}, {"block": 10000, "pivots": 25}, {"block": 25, "pivots": 1}])
def test_neighbours_are_exact(hot, options):
    rows, frame = hot
    got: dict[int, list[int]] = {}
    for r in neighbours(frame, 4, **options).orderBy("id", "rank").collect():
        got.setdefault(r["id"], []).append(r["neighbour"])
        assert r["rank"] == len(got[r["id"]])
    assert got == brute_force(rows, 4)


def test_vectors_are_sent_once_to_a_block_of_cells(spark, monkeypatch):
    """Without structure nearly every cell is asked for, but a query goes to a block once."""
    vectors = np.random.default_rng(3).normal(size=(400, 16)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    sent = {}

    def counted(df, name="cut"):
        table = cut(df, name)
        sent[name] = table.count()
        return table

    monkeypatch.setattr(searches, "cut", counted)
    got: dict[int, list[int]] = {}
    for r in neighbours(spark.createDataFrame(rows, SCHEMA), 4, block=130, pivots=24).orderBy("id", "rank").collect():
        got.setdefault(r["id"], []).append(r["neighbour"])
    assert got == brute_force(rows, 4)
    assert 0 < sent["queries"] <= 6 * len(rows)


def test_what_is_sent_grows_with_the_table(spark, monkeypatch):
    """With blocks that grow, a vector is sent as often in a table five times as long."""
    sent = {}

    def counted(df, name="cut"):
        table = cut(df, name)
        sent[name] = table.count()
        return table

    monkeypatch.setattr(searches, "cut", counted)
    monkeypatch.setattr(searches, "BLOCK", 32)
    vectors = np.random.default_rng(4).normal(size=(2000, 16)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    each = []
    for n in (400, 2000):
        neighbours(spark.createDataFrame(rows[:n], SCHEMA), 4).count()
        each.append(sent["queries"] / n)
    assert 1 < each[1] < 1.3 * each[0]


def test_what_is_sent_is_small(spark, monkeypatch):
    """A vector goes to at most five blocks, and one of floats goes as floats."""
    sent = {}

    def counted(df, name="cut"):
        table = cut(df, name)
        sent[name] = table.count(), [kind for _, kind in table.dtypes]
        return table

    monkeypatch.setattr(searches, "cut", counted)
    monkeypatch.setattr(searches, "BLOCK", 32)
    vectors = np.random.default_rng(6).normal(size=(1200, 16)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    got: dict[int, list[int]] = {}
    for r in neighbours(spark.createDataFrame(rows, SCHEMA), 4, pivots=24).orderBy("id", "rank").collect():
        got.setdefault(r["id"], []).append(r["neighbour"])
    assert got == brute_force(rows, 4)
    count, kinds = sent["queries"]
    assert len(rows) < count <= 5 * len(rows)
    assert "array<float>" in kinds and "array<double>" not in kinds


@pytest.mark.parametrize("kind", ["float", "double"])
def test_ties_and_copies_of_other_lengths(spark, monkeypatch, kind):
    """Whole-number vectors: many distances are equal, many rows differ in length only."""
    monkeypatch.setattr(searches, "PAIRS", 3000)  # several slices of a cell
    vectors = np.random.default_rng(8).integers(-1, 2, size=(500, 5)) * np.random.default_rng(9).choice([1, 2, 4], (500, 1))
    rows = [(i, v.tolist()) for i, v in enumerate(vectors.astype(float))]
    for options in ({"block": 60, "pivots": 7}, {}):
        got: dict[int, list[int]] = {}
        frame = spark.createDataFrame(rows, f"id long, vector array<{kind}>")
        for r in neighbours(frame, 6, **options).orderBy("id", "rank").collect():
            got.setdefault(r["id"], []).append(r["neighbour"])
        assert got == brute_force(rows, 6)


def test_vectors_that_are_no_numbers_are_left_out(spark):
    rows = [(i, v.tolist()) for i, v in enumerate(np.random.default_rng(10).normal(size=(60, 4)))]
    odd = [(100, [1.0, math.nan, 0.0, 0.0]), (101, [math.inf, 1.0, 0.0, 0.0]), (102, None), (103, [1.0, None, 0.0, 0.0])]
    got: dict[int, list[int]] = {}
    frame = spark.createDataFrame(rows + odd, "id long, vector array<double>")
    for r in neighbours(frame, 3, block=20, pivots=4).orderBy("id", "rank").collect():
        got.setdefault(r["id"], []).append(r["neighbour"])
    assert got == brute_force(rows, 3)


def test_chunks_are_runs_of_cells():
    assert searches._chunks(np.array([5, 0, 5, 1, 30, 2, 8, 0]), 10).tolist() == [0, 0, 0, 1, 2, 3, 3, 3]


def test_fewer_points_than_k_and_none(spark):
    few = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [1.0, 1.0])], "id string, vector array<float>")
    rows = neighbours(few, 5).orderBy("id", "rank").collect()
    assert [(r["id"], r["rank"], r["neighbour"]) for r in rows] == [("a", 1, "a"), ("a", 2, "b"), ("b", 1, "b"), ("b", 2, "a")]
    assert rows[1]["distance"] == pytest.approx(1 - math.sqrt(0.5))
    assert neighbours(few.limit(0), 5).count() == 0


def test_local_scale_solves_its_equation(hot):
    _, frame = hot
    near = neighbours(frame.where("id between 0 and 599"), 5).cache()
    for r in local_scale(near, 5).limit(200).collect():
        d = [e["distance"] for e in r["near"]]
        assert r["rho"] == min(x for x in d if x > 0)
        total = sum(math.exp(-max(0.0, x - r["rho"]) / r["sigma"]) for x in d[1:])
        assert total == pytest.approx(math.log2(5), abs=2e-5)
    graph = fuzzy_graph(near, 5).collect()
    pairs = {(r["id"], r["neighbour"]) for r in near.where("rank > 1").collect()}
    assert {(r["a"], r["b"]) for r in graph} == {(min(p), max(p)) for p in pairs}
    assert all(0 < r["weight"] <= 1 for r in graph)


def test_unit_and_cosine(spark):
    rows = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<float>, b array<float>")
    got = rows.select(unit(F.col("a")).alias("u"), F.when(F.col("a")[0] > 0, cosine(F.col("a"), F.col("b"))).alias("c")).collect()
    assert got[0]["u"] == pytest.approx([0.6, 0.8]) and got[0]["c"] == pytest.approx(0.96)
    assert got[1]["u"] is None


def test_hashed_words_against_a_plain_count(spark):
    import hashlib

    texts = ["The cat  the\nCAT a", "", "x " * 5000 + "y", "é b c\td"]
    frame = spark.createDataFrame(list(enumerate(texts)), "id int, body string")
    for row in hashed_words(frame).collect():
        words = [w for w in row["body"].lower().replace("\n", " ").replace("\t", " ").split(" ") if w]
        want = np.zeros(256)
        for w in words:
            want[int(hashlib.md5(w.encode()).hexdigest()[:2], 16)] += 1
        size = np.linalg.norm(want)
        assert row["vector"] == pytest.approx(list(want / size if size else want), abs=1e-6)


def test_own_encoder_keeps_order_and_batches(spark):
    def make():
        def encode(texts):
            assert len(texts) <= 3
            return np.array([[len(t), ord(t[0])] for t in texts])

        return encode

    frame = spark.createDataFrame([(i, chr(97 + i % 20) * (i + 1)) for i in range(50)], "id int, body string")
    for row in encoded(frame, make, batch_size=3).collect():
        assert row["vector"] == [len(row["body"]), ord(row["body"][0])]


def test_mean_pool_and_shape(spark):
    rows = spark.createDataFrame([(i, [float(i), 1.0], "hot" if i % 3 else "cold") for i in range(300)], "id long, vector array<float>, label string")
    got = {r["label"]: (r["n"], r["mean"]) for r in mean_pool(rows, "label").collect()}
    assert got["cold"] == (100, pytest.approx([148.5, 1.0]))
    assert got["hot"] == (200, pytest.approx([150.0, 1.0]))
    assert tuple(shape(rows).first()) == (300, 2)


def test_pca_keeps_the_main_directions(spark):
    rng = np.random.default_rng(5)
    m = rng.normal(size=(300, 6)) * np.array([5, 3, 2, 0.1, 0.1, 0.1])
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id long, vector array<double>")
    rows = pca_3d(frame).orderBy("id").collect()
    got = np.array([[r["x"], r["y"], r["z"]] for r in rows])
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    _, _, axes = np.linalg.svd(u - u.mean(axis=0), full_matrices=False)
    want = u @ axes[:3].T
    for i in range(3):
        sign = 1 if axes[i][np.abs(axes[i]).argmax()] > 0 else -1
        assert got[:, i] == pytest.approx(want[:, i] * sign, abs=1e-6)


def test_clusters(spark):
    points = [[10.0, 0.1 * i] for i in range(20)] + [[0.1 * i, 10.0] for i in range(20)]
    frame = spark.createDataFrame(list(enumerate(points)), "id long, vector array<double>")
    topics = {r["id"]: r["topic"] for r in kmeans_topics(frame, 2).collect()}
    assert len({topics[i] for i in range(20)}) == 1 and topics[0] != topics[39]
    members = cluster_members(frame.withColumn("c", (F.col("id") >= 20).cast("int")), "c")
    summary = {r["c"]: r for r in cluster_summary(members, "c").collect()}
    assert summary[0]["size"] == 20 and 0 < summary[0]["mean_distance"] < summary[0]["max_distance"] < 0.01
    central = central_rows(members, "c", "id", 2).where("c = 0").orderBy("rank").collect()
    assert {r["id"] for r in central} <= {8, 9, 10, 11}


def test_store(spark, tmp_path):
    rows = spark.createDataFrame(
        [("a", "T", "body", [1, 2], None, 1.5), ("b", None, "body", None, True, 2.0)],
        "id string, title string, body string, tags array<int>, flag boolean, score double",
    )
    stored = rows.withColumn("attrs", attrs_of(rows)).withColumn("vector", F.array(F.lit(0.5), F.lit(2.0)))
    write_store(stored, str(tmp_path / "s"))
    back = {r["id"]: r for r in read_store(spark, str(tmp_path / "s")).collect()}
    assert back["a"]["vector"] == [0.5, 2.0] and back["a"]["title"] == "T"
    attrs = {r["id"]: r["attrs"] for r in spark.read.parquet(str(tmp_path / "s")).collect()}
    assert attrs["a"] == {"id": "a", "title": "T", "tags": "[1,2]", "flag": "null", "score": "1.5"}
    assert attrs["b"]["tags"] == "null" and "body" not in attrs["b"]
    points = spark.createDataFrame([("a", 1.0, 2.0, 3.0)], "id string, x double, y double, z double")
    assert points_with_text(points, read_store(spark, str(tmp_path / "s"))).first()["hover"] == "ID: a<br>Title: T"
