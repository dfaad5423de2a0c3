"""Exact, near and line dedup against brute force."""

import hashlib
import itertools
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import __spark_entry__ as entry
from llm_cases import SF, awkward, documents, empty, groups
from softgrove.llm import exact_dedup, line_dedup, simhash_dedup
from softgrove.llm.components import components

ASCII_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def plain_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(ASCII_LOWER))
    if not words:
        return 0
    shingles = [b" ".join(words[k:k + 3]) for k in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows, radius=2):
    """(fingerprint, smallest id) for each row (id, text)."""
    fps = [plain_fingerprint(t) for _, t in rows]
    near = [(a, b) for a, b in itertools.combinations(range(len(rows)), 2) if (fps[a] ^ fps[b]).bit_count() <= radius]
    root = groups(len(rows), near)
    ids = {}
    for k, (d, _) in enumerate(rows):
        ids.setdefault(root[k], []).append(d)
    least = {k: min((x for x in v if x is not None), default=None) for k, v in ids.items()}
    return [(f"{fps[k]:016x}", least[root[k]]) for k in range(len(rows))]


def test_op5_against_all_pairs(spark):
    rows = [(d, t) for d, t, _, _ in documents()]
    want = {d: x for (d, _), x in zip(rows, plain_components(rows))}
    got = entry.queries()["op5_simhash_dedup"](spark, SF).collect()
    assert len(got) == len(rows)
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == want


@pytest.mark.parametrize("tile,per_task", [(1, 1), (4, 3), (64, 24), (4096, 24)])
def test_tiles_of_any_size_give_the_same_links(spark, tile, per_task):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    near = [int(b) ^ (1 << int(x)) ^ (1 << int(y)) for b in base for x, y in rng.integers(0, 64, (4, 2))]
    fps = sorted({int(b) for b in base} | set(near) | {0, 1, 3, 7, 2**64 - 1, 2**64 - 2})
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    found = components(simhash_dedup.links(df, 2, tile, per_task)).collect()
    got = {r["node"]: r["component"] for r in found}
    want = groups(len(fps), [(a, b) for a, b in itertools.combinations(range(len(fps)), 2)
                             if (fps[a] ^ fps[b]).bit_count() <= 2])
    mine = {}
    for k, x in enumerate(signed):
        mine.setdefault(got.get(x, x), set()).add(k)
    theirs = {}
    for k, r in enumerate(want):
        theirs.setdefault(r, set()).add(k)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, theirs.values()))


def test_near_dedup_awkward(spark):
    docs = awkward(spark)
    local = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = sorted(zip([d for d, _ in local], plain_components(local)), key=repr)
    got = [(r["id"], (f"{r['fp'] & (2**64 - 1):016x}", r["keep_id"])) for r in simhash_dedup.near_duplicates(docs).collect()]
    assert sorted(got, key=repr) == want
    kept = simhash_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
    assert sorted(ids, key=repr) == sorted({w[1][1] for w in want if w[1][1] is not None} | {None}, key=repr)


def test_exact_dedup_awkward(spark):
    docs = awkward(spark)
    got = {(r["id"], r["sha256"]): (r["keep_id"], r["group_size"], r["kept"])
           for r in exact_dedup.membership(docs).collect()}
    local = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    want = {}
    for d, t in local:
        same = [x for x, y in local if y == t]
        keep = max((x for x in same if x is not None), default=None)
        want[d, hashlib.sha256(t.encode()).hexdigest()] = (keep, len(same), d == keep)
    assert got == want
    kept = exact_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    texts = [r["text"] or "" for r in kept.select("text").collect()]
    assert sorted(texts) == sorted({t for _, t in local})


def test_exact_dedup_is_native(spark):
    plan = exact_dedup.membership(spark.read.parquet(f"{SF}/documents.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def plain_lines(rows):
    """(id, line number) -> occurrence that stays, by comparing all lines with all."""
    lines, places = {}, {}
    for d, text in rows:
        for k, line in enumerate((text or "").split("\n")):
            line = line_dedup.normalise(line)
            if len(line.split()) >= line_dedup.MIN_WORDS:
                lines.setdefault(line, []).append((d, k))
                places[d, k] = line
    distinct = sorted(lines)
    fps = [sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))
           for hs in ([xxhash.xxh64_intdigest(w, 3) for w in set(line.split(" "))] for line in distinct)]
    near = [(a, b) for a, b in itertools.combinations(range(len(distinct)), 2)
            if (fps[a] ^ fps[b]).bit_count() <= line_dedup.RADIUS and line_dedup.similar(distinct[a], distinct[b], 0.8)]
    root = dict(zip(distinct, groups(len(distinct), near)))
    first = {}
    for place, line in places.items():
        first[root[line]] = min(first.get(root[line], place), place)
    return {place: first[root[line]] for place, line in places.items()}, near


def test_op3_against_all_pairs(spark):
    want, near = plain_lines([(d, t) for d, t, _, _ in documents()])
    assert near
    got = entry.queries()["op3_line_dedup"](spark, SF).collect()
    assert {(r["doc_id"], r["line_no"]): (r["first_doc_id"], r["first_line_no"]) for r in got} == want
    assert all(r["kept"] == ((r["doc_id"], r["line_no"]) == (r["first_doc_id"], r["first_line_no"])) for r in got)


@pytest.mark.parametrize("chunk", [1, 3, 1024])
def test_lines_with_hot_keys(spark, chunk):
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"
    words = base.split()
    texts = [" ".join(words[:k] + [words[k] + "s"] + words[k + 1:]) for k in range(len(words))] * 2 + [base, base.upper()]
    rows = list(enumerate(texts))
    want, near = plain_lines(rows)
    assert near
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = line_dedup.line_groups(docs, chunk=chunk).collect()
    assert {(r["id"], r["line_no"]): (r["first"]["id"], r["first"]["line_no"]) for r in got} == want


def test_lines_taken_out(spark):
    docs = awkward(spark)
    out = line_dedup.deduplicated(docs)
    assert out.columns == docs.columns
    got = {(r["doc_id"], r["lang"], r["source"]): r["text"] for r in out.filter("doc_id IS NOT NULL").collect()}
    assert got[15, "en", "b"] == "a\nb\na\n\nthe same line of seven words here"
    assert got[3, None, None] is None and got[4, "en", "a"] == ""
    assert got[2, "en", "b"] == "" and got[1, "en", "a"].startswith("the quick")
    assert got[9, "en", "c"] and got[10, "en", "c"] == ""
    assert out.count() == docs.count()


@pytest.mark.parametrize("a,b,distance", [("", "", 0), ("", "abc", 3), ("kitten", "sitting", 3), ("abcdef", "abXdef", 1),
                                          ("a" * 300, "a" * 299 + "b", 1), ("flaw", "lawn", 2)])
def test_edit_distance(a, b, distance):
    assert line_dedup.edit_distance(a, b) == line_dedup.edit_distance(b, a) == distance


def test_components(spark):
    chain = [(k, k + 1) for k in range(100, 160)] + [(5, 9), (9, 7), (7, 5), (3, 3), (None, 4), (5, 9)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {k: 100 for k in range(100, 161)} | {5: 5, 7: 5, 9: 5}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("run", [exact_dedup.membership, exact_dedup.keep_one, simhash_dedup.near_duplicates,
                                 simhash_dedup.keep_one, line_dedup.line_groups, line_dedup.deduplicated])
def test_empty_tables(spark, run):
    assert run(empty(spark)).count() == 0


def test_blocks_follow_the_number_of_lines():
    assert line_dedup.blocks_for(10, 3) == 5 and line_dedup.blocks_for(10**9, 3) > 5
    for m in (5, 6):
        cut = line_dedup.masks(m, 3)
        rng = np.random.default_rng(0)
        for _ in range(200):
            differ = sum(1 << int(k) for k in rng.choice(64, 3, replace=False))
            assert any(differ & c == 0 for c in cut)
    assert simhash_dedup.blocks_for(10) == 1 and simhash_dedup.blocks_for(10**7) >= 4


def test_no_text_column_is_shuffled(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("extra", F.lit(1))
    assert simhash_dedup.fingerprints(docs).columns == ["id", "text_hash", "fp"]
