"""The stages against plain versions of what each decides."""

from collections import Counter, defaultdict

import corpus_pipeline
from test_dedup import alike, cleaned, components, shingles

from dateline.llm import decontaminate, toxicity

SF = "/root/testdata/sf0.001"


def test_names_and_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "toxicity", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "best_fit_packing",
    ]


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    first = stages["toxicity"](spark, docs, SF)
    model = toxicity.learned(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    bad = {r["doc_id"] for r in docs.where(toxicity.score(model, docs["text"]) >= 0.7).collect()}
    assert first.columns == docs.columns
    assert {r["doc_id"] for r in first.collect()} == {r["doc_id"] for r in docs.collect()} - bad

    second = stages["line_dedup"](spark, docs, SF)
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert Counter((r["doc_id"], r["text"]) for r in second.collect()) == Counter((i, t) for i, t, _, _ in cleaned(texts))
    assert all(r["n_chars"] == len(r["text"]) for r in second.collect())

    third = stages["simhash_near_dedup"](spark, docs, SF)
    groups = defaultdict(list)
    for (i, _), c in zip(texts, components([shingles(t) for _, t in texts], alike)):
        groups[c].append(i)
    assert sorted(r["doc_id"] for r in third.collect()) == sorted(min(g) for g in groups.values())

    fourth = stages["benchmark_decontamination"](spark, docs, SF)
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    held = [" ".join(r["text"].split()) for r in items.collect()]
    verbatim = {i for i, t in texts if any(h in " ".join(t.split()) for h in held)}
    kept = {r["doc_id"] for r in fourth.collect()}
    assert verbatim and not kept & verbatim
    found = {r["doc_id"] for r in decontaminate.leaks(docs, items).collect()}
    assert kept == {i for i, _ in texts} - found

    for name in list(stages)[:4]:
        assert stages[name](spark, docs.limit(0), SF).collect() == []


def test_run(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    rows = got.collect()
    assert 0 < len({r["doc_id"] for r in rows}) < 200
    assert max(Counter(r["sequence_id"] for r in rows).values()) > 1
