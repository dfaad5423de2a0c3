"""The pipeline against its stages done by hand."""

import re

import corpus_pipeline
from llm_cases import awkward, documents, empty
from softgrove.llm.common import written
from test_llm_dedup import plain_components

SF = "/root/testdata/sf0.001"


def run_stages(spark, docs):
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(written(stage(spark, out[-1], SF), "stage"))
    return out


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first, rules, exact, near, mixed, packed = run_stages(spark, docs)
    text = {d: t for d, t, _, _ in documents()}
    for df in (rules, exact, near, mixed):
        assert df.columns == docs.columns
    ids = [[r["doc_id"] for r in df.select("doc_id").collect()] for df in (rules, exact, near, mixed)]
    kept = set(ids[0])
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = [d for d, q in labels.items() if q == 1 and len(text[d].split()) >= 20]
    assert sum(d in kept for d in good) >= 0.9 * len(good)
    largest = {}
    for d in kept:
        largest[text[d]] = max(d, largest.get(text[d], d))
    assert sorted(ids[1]) == sorted(largest.values())
    rows = [(d, text[d]) for d in ids[1]]
    assert sorted(ids[2]) == sorted({least for _, least in plain_components(rows)})
    assert set(ids[3]) <= set(ids[2]) and max(map(ids[3].count, set(ids[3]))) <= 2
    words = lambda ds: sum(len(re.findall(r"\S+", text[d])) for d in ds)
    assert 1.3 < words(ids[3]) / words(ids[2]) < 1.7
    pieces = packed.collect()
    assert all(len(p["ids"]) == 4 * p["length"] and p["offset"] == 0 for p in pieces)
    per_copy = sum(p["length"] for p in pieces)
    tokens = {p["doc_id"]: p["doc_tokens"] for p in pieces}
    assert per_copy == sum(tokens[d] for d in ids[3])
    assert len({p["sequence_id"] for p in pieces}) == len(pieces)


def test_run_equals_its_stages(spark):
    got = corpus_pipeline.run(spark, SF).count()
    assert got == run_stages(spark, spark.read.parquet(f"{SF}/documents.parquet"))[-1].count()


def test_awkward_and_empty(spark):
    for docs in (awkward(spark), empty(spark)):
        stages = run_stages(spark, docs)
        assert all(df.columns == docs.columns for df in stages[:-1])
    assert stages[-1].count() == 0
