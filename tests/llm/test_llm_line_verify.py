"""Line dedup: most pairs are settled by whole words, and words are numbered by Arrow."""

from __future__ import annotations

import random

import numpy as np
import xxhash

from softgrove.llm import line_dedup


def test_replaced_words_need_no_edit_table(monkeypatch):
    monkeypatch.setattr(line_dedup, "edit_distance", lambda a, b: 1 / 0)
    words = [f"word{k}" for k in range(60)]
    other = [*words[:5], "x", *words[6:30], "some", "more", *words[30:50], "y", *words[51:]]
    assert line_dedup.similar(" ".join(words), " ".join(other), 0.8)
    assert line_dedup.similar(" ".join(other), " ".join(words), 0.8)


def test_bound_by_words():
    rng = random.Random(2)
    for _ in range(500):
        a = [rng.choice(["a", "bb", "ccc", "dddd", "e0"]) for _ in range(rng.randint(1, 12))]
        b = [w if rng.random() < 0.8 else rng.choice(["f", "gg", "bbb"]) for w in a if rng.random() < 0.9] or ["a"]
        a, b = " ".join(a), " ".join(b)
        assert line_dedup.at_most(a, b) == line_dedup.at_most(b, a) >= line_dedup.edit_distance(a, b)
        assert line_dedup.similar(a, b, 0.8) == (line_dedup.edit_distance(a, b) <= 0.2 * max(len(a), len(b)) + 1e-9)


def test_fingerprints_by_distinct_words():
    lines = ["a b a b", "\u00e9 \u00fcn x\u00ef", "x", "y " * 700 + "z", " ".join(str(k) for k in range(1000)), "b a"]
    got = line_dedup.fingerprints(lines).view(np.uint64).tolist()
    for line, fp in zip(lines, got):
        hashes = [xxhash.xxh64_intdigest(w.encode(), 3) for w in set(line.split(" "))]
        assert fp == sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def test_folded_text_is_folded_lines():
    for text in ["A1\nB 2\tC", "\u0391\u03a3\n\u0392 \u03a3 7", "\u0130I\n\u0663\u00b2", "\x1c A\x85 9Z", ""]:
        whole = [" ".join(x.split()) for x in line_dedup.folded(text).split("\n")]
        assert whole == [line_dedup.normalise(x) for x in text.split("\n")]
        assert whole == [" ".join(line_dedup.DIGIT.sub("0", x.lower()).split()) for x in text.split("\n")]
