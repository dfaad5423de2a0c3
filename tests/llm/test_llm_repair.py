"""Conversation repair against a plain dynamic program over single messages."""

import hashlib
import itertools
import random
import zlib
from functools import lru_cache

import duckdb
import pytest

import __spark_entry__ as entry
from softgrove.llm import conversation_repair as cr

WHITE = " \t\n\x0b\x0c\r"
SF001 = "/root/testdata/sf0.001"


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if code == 1:
            text = ""
        if code == 2:
            text = "".join(c for c in text if c not in ".!?")
        if code == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if code == 0 else 2 if code == 3 else 1)
    return out


def plain_audit(messages):
    """(fault, role) of each message in order -> least (cost, audit), one message and edit at a time."""
    def allowed(state, initial):
        return {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}.get((state, initial))

    @lru_cache(None)
    def best(p, state, inserted):
        found = []
        if p == len(messages):
            if state in ("", "a"):
                found.append((0, ""))
        else:
            fault, role = messages[p]
            ways = [("D", 2, state)]
            if fault not in ("blank", "duplicate"):
                extra = 5 if fault == "truncated" else 0
                ways += [("K", extra, allowed(state, role[:1]))]
                ways += [("R", 1 + extra, allowed(state, r)) for r in "ua"]
            for edit, cost, to in ways:
                if to is not None:
                    rest = best(p + 1, to, 0)
                    found.append((cost + rest[0], edit + rest[1]))
        if inserted < 3:
            for r in "ua":
                if allowed(state, r):
                    rest = best(p, allowed(state, r), inserted + 1)
                    found.append((5 + rest[0], "I" + rest[1]))
        return min(found, default=(10**9, ""))

    for p in range(len(messages), 0, -50):  # keeps the recursion short
        for state in ("", "s", "u", "a"):
            best(p, state, 0)
    return best(0, "", 0)


def plain_repair(rows):
    """Rows of one conversation after damage -> the query's columns."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), hashlib.sha256(r[3].encode()).digest()))
    faults, seen = [], set()
    for _, _, role, text in rows:
        shown = text.strip(WHITE)
        faults.append("blank" if not shown else "duplicate" if (role, text) in seen else
                      "truncated" if shown[-1] not in ".!?" else "")
        seen.add((role, text))
    cost, audit = plain_audit(tuple((f, r[2]) for f, r in zip(faults, rows)))
    lines, at, state = [], 0, ""
    for edit in audit:
        text = ""
        if edit != "I":
            _, _, role, text = rows[at]
            at += 1
        if edit == "D":
            continue
        if edit != "K":
            role = "assistant" if state == "u" else "user"
        state = role[:1]
        lines.append(f"{role}:{text}")
    turns = [r[1] for r in rows if r[1] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return (gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest())


def plain(rows, damaged=True):
    after = plain_damage(rows) if damaged else [(c, t, *[" " if x is None else x for x in (r, s)]) for c, t, r, s in rows]
    return {c: plain_repair([r for r in after if r[0] == c]) for c in {r[0] for r in rows}}


def repaired(df):
    out = cr.audited(df).collect()
    assert len({r["conv_id"] for r in out}) == len(out)
    return {r["conv_id"]: tuple(r)[1:] for r in out}


SCHEMA = "conv_id long, turn int, role string, text string"


def random_rows(seed, conversations, longest, extra=()):
    rng = random.Random(seed)
    rows = list(extra)
    for c in range(conversations):
        shift = rng.choice([0, 0, 3])
        for t in range(rng.randrange(longest)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "Unknown"])
            text = rng.choice(["Yes.", "no", "", " \t", "a!\n ", "é? ", f"{t}.", f"{t}", None, "Yes."])
            rows.append((c, rng.choice([t, t + shift, t, None]), role, text))
    return rows


@pytest.mark.parametrize("partitions", [1, 7, 40])
def test_random_conversations(spark, partitions):
    rows = random_rows(partitions, 60, 14)
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # pieces of conversations in many partitions
    try:
        df = spark.createDataFrame(rows, SCHEMA).repartition(5)
        assert repaired(cr.damage(df)) == plain(rows)
        assert repaired(df) == plain(rows, damaged=False)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_every_short_conversation():
    """All sequences of up to four symbols, and runs of them."""
    repairer = cr.Repairer()
    kinds = [("blank", "user"), *itertools.product(["", "truncated"], ["system", "user", "assistant", "tool"])]
    sequences = [s for n in range(5) for s in itertools.product(kinds, repeat=n)]
    sequences += [tuple(k for k, n in zip(s, ns) for _ in range(n))
                  for s in itertools.product(kinds[:5], repeat=2) for ns in ((70, 3), (5, 66), (9, 9))]
    for seq in sequences:
        runs = []
        for fault, role in seq:
            symbol = cr.DEAD if fault == "blank" else cr.symbol_of(role[:1], fault == "truncated")
            if runs and runs[-1][0] == symbol:
                runs[-1][1] += 1
            else:
                runs.append([symbol, 1])
        audit, _, cost = repairer.whole(runs)
        assert (cost, audit) == plain_audit(seq), seq


def test_hot_conversation(spark):
    """One conversation with most rows, cut into pieces; equal messages thousands of times."""
    rng = random.Random(9)
    rows = [(7, t, rng.choice(["user", "assistant"]), f"Line {t}{rng.choice(['.', ''])}") for t in range(700)]
    rows += [(7, 3, "user", "The same.")] * 400 + [(8, t, "user", "The same.") for t in range(300)] + [(9, 0, "user", None)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert repaired(spark.createDataFrame(rows, SCHEMA)) == plain(rows, damaged=False)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_op12_whole_table(spark):
    rows = duckdb.sql(f"SELECT conv_id, turn, role, text FROM '{SF001}/conversations.parquet'").fetchall()
    out = entry.queries()["op12_conversation_repair"](spark, SF001)
    assert out.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert {r["conv_id"]: tuple(r)[1:] for r in out.collect()} == plain(rows)


def test_awkward(spark):
    nothing = hashlib.sha256(b"").hexdigest()
    assert repaired(spark.createDataFrame([], SCHEMA)) == {}
    dropped = next(t for t in range(1000) if zlib.crc32(f"5:{t}".encode()) % 20 == 0)
    rows = [(5, dropped, "user", "Gone."), (None, None, "user", "x" * 3_000_000 + "."), (None, 1, "assistant", "Y.")]
    got = repaired(cr.damage(spark.createDataFrame(rows, SCHEMA)))
    assert got == plain(rows) and got[5] == (0, 0, 0, 0, 0, 0, "", nothing)
    names = "audit string, digest string, t string, kind string, conv string, n string, seen string, cost string"
    wide = spark.createDataFrame([(*r, *"abcdefgh") for r in rows], f"{SCHEMA}, {names}")
    assert repaired(cr.damage(wide)) == got
    texts = spark.createDataFrame([("b", 1, "user", "Ask."), ("b", 2, "user", "Reply."), ("a", 1, "assistant", "Hm.")],
                                  "conv_id string, turn long, role string, text string")
    assert sorted(map(tuple, cr.repaired(texts).collect())) == [("b", 0, "user", "Ask."), ("b", 1, "assistant", "Reply.")]
