"""Conversation structure repair: cheapest edits that give a conversation the roles (system? (user assistant)+)?.

A message that is blank, or repeats role and text of an earlier one, must be
deleted. Others are kept (0), given the other role (1) or deleted (2); an empty
message may be inserted anywhere (5), and a message cut off before its end that
stays costs 5 more. Among the cheapest edit sequences the one whose audit, the
initials of its edits in order, is least in ASCII is taken; it fixes all roles.

Each message is a symbol of role initial and fault. Equal symbols in a row form a
run. A symbol is a 4 x 4 min-plus matrix between the states of the pattern
(nothing, after system, after user, after assistant), with insertions before the
message; a run advances by cached binary powers of its matrix. The costs to go at
the ends of the runs then decide the edits of each run from its start.

Messages are counted first by (conversation, turn, role, digest of the text),
sorted by range and cut wherever a partition ends, so one conversation may span
many tasks: the pieces at the edges of partitions hand on their min-plus product,
get the costs to go at their end, and unroll their choices for every state in
which they may be entered. Texts are not moved for this. They are sent once per
conversation and different message, and streamed in order beside the audit; a
SHA-256 over a conversation can't be split, so that stream is one task for each
conversation, in constant memory.

Order: by turn, nulls first, then by role, then by the digest of the text. Null
roles and texts are one space, a null conversation is one of its own. Repeated
rows are messages of their own (all but the first are duplicates). An empty table
gives an empty result; columns besides the four named ones are not read.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from softgrove.llm.common import batches_of, written

SPACE = " \t\n\x0b\x0c\r"
NO_TURN = -(1 << 63)
ENDLESS = 1 << 60
REROLE, DELETE, INSERT, CUT_OFF = 1, 2, 5, 5
START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: what an inserted or re-roled message becomes in each state
NEXT = (USER, USER, ASSISTANT, USER)
DEAD = 0
BLOCK = 64
STATS = ("blank", "duplicate", "truncated", "illegal", "distinct")
BATCH_ROWS = 64

Vector = tuple[int, int, int, int]
Matrix = tuple[Vector, Vector, Vector, Vector]


def symbol_of(initial: str, truncated: bool) -> int:
    return 1 + 2 * ("sua".find(initial) if initial else -1) + 2 + truncated


def kept_state(symbol: int, state: int) -> int | None:
    """State after keeping a message in its role, if the pattern allows it."""
    role = (symbol - 1) // 2 - 1
    if role == 0:
        return SYSTEM if state == START else None
    if role == 1:
        return USER if state != USER else None
    return ASSISTANT if role == 2 and state == USER else None


def times(a: Matrix, b: Matrix) -> Matrix:
    return tuple(tuple(min(a[i][k] + b[k][j] for k in range(4)) for j in range(4)) for i in range(4))


def onto(a: Matrix, v: Vector) -> Vector:
    return tuple(min(a[i][k] + v[k] for k in range(4)) for i in range(4))


IDENTITY: Matrix = tuple(tuple(0 if i == j else ENDLESS for j in range(4)) for i in range(4))


class Repairer:
    """Matrices of the symbols, their binary powers, and the choices made so far."""

    def __init__(self) -> None:
        insert = [[0 if i == j else INSERT if NEXT[i] == j else ENDLESS for j in range(4)] for i in range(4)]
        once: Matrix = tuple(map(tuple, insert))
        self.inserting = times(once, times(once, once))
        self.at_end: Vector = tuple(min(self.inserting[i][START], self.inserting[i][ASSISTANT]) for i in range(4))
        self.powers: dict[int, list[Matrix]] = {}
        self.steps: dict[tuple, tuple[Vector, tuple]] = {}

    def power(self, symbol: int, bit: int) -> Matrix:
        """Matrix of 2**bit equal messages."""
        known = self.powers.get(symbol)
        if known is None:
            rows = [[ENDLESS] * 4 for _ in range(4)]
            for i in range(4):
                rows[i][i] = DELETE
                if symbol != DEAD:
                    extra = CUT_OFF * ((symbol - 1) % 2)
                    rows[i][NEXT[i]] = min(rows[i][NEXT[i]], REROLE + extra)
                    j = kept_state(symbol, i)
                    if j is not None:
                        rows[i][j] = min(rows[i][j], extra)
            known = self.powers[symbol] = [times(self.inserting, tuple(map(tuple, rows)))]
        while len(known) <= bit:
            known.append(times(known[-1], known[-1]))
        return known[bit]

    def run_before(self, symbol: int, count: int, after: Vector) -> Vector:
        """Costs to go before a run from those after it."""
        for bit in range(count.bit_length()):
            if count >> bit & 1:
                after = onto(self.power(symbol, bit), after)
        return after

    def product(self, runs: list[tuple[int, int]]) -> Matrix:
        out = IDENTITY
        for symbol, count in runs:
            for bit in range(count.bit_length()):
                if count >> bit & 1:
                    out = times(out, self.power(symbol, bit))
        return out

    def step(self, symbol: int, after: Vector) -> tuple[Vector, tuple]:
        """Costs to go before one message and, by state, its edits and the state after it."""
        least = min(after)
        key = (symbol, after[0] - least, after[1] - least, after[2] - least, after[3] - least)
        known = self.steps.get(key)
        if known is None:
            rest: Vector = key[1:]
            before = onto(self.power(symbol, 0), rest)
            known = self.steps[key] = before, tuple(self._edits(symbol, i, before, rest) for i in range(4))
        before = known[0]
        return tuple(x + least for x in before), known[1]

    def _edits(self, symbol: int, state: int, before: Vector, after: Vector) -> tuple[str, int]:
        out = ""
        extra = CUT_OFF * ((symbol - 1) % 2) if symbol != DEAD else 0
        while True:
            left = before[state]
            if DELETE + after[state] == left:
                return out + "D", state
            if INSERT + before[NEXT[state]] == left:
                out, state = out + "I", NEXT[state]
                continue
            kept = kept_state(symbol, state)
            if kept is not None and extra + after[kept] == left:
                return out + "K", kept
            return out + "R", NEXT[state]

    def unroll(self, runs: list[tuple[int, int]], end: Vector, state: int) -> tuple[str, str, int]:
        """Audit, audit without the messages that must go, and the state after the runs."""
        ends = [end]
        for symbol, count in reversed(runs):
            ends.append(self.run_before(symbol, count, ends[-1]))
        ends.reverse()
        audit, live = [], []
        for (symbol, count), after in zip(runs, ends[1:]):
            for first in range(0, count, BLOCK):
                here = min(BLOCK, count - first)
                costs = self.run_before(symbol, count - first - here, after)
                choices = []
                for _ in range(here):
                    costs, choice = self.step(symbol, costs)
                    choices.append(choice)
                for choice in reversed(choices):
                    edits, state = choice[state]
                    audit.append(edits)
                    live.append(edits[:-1] if symbol == DEAD else edits)
        return "".join(audit), "".join(live), state

    def ending(self, state: int) -> str:
        """Insertions after the last message."""
        return "I" * (self.at_end[state] // INSERT)

    def whole(self, runs: list[tuple[int, int]]) -> tuple[str, str, int]:
        """Audit, live audit and cost of a conversation."""
        audit, live, state = self.unroll(runs, self.at_end, START)
        before = self.at_end
        for symbol, count in reversed(runs):
            before = self.run_before(symbol, count, before)
        return audit + self.ending(state), live + self.ending(state), before[START]


def damage(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text") -> DataFrame:
    """Rows with faults put in by a hash of conversation and turn; ``copies`` 0 is a row that was dropped."""
    part = lambda c: F.coalesce(df[c].cast("string"), F.lit(" "))
    code = F.crc32(F.concat(part(conv_col), F.lit(":"), part(turn_col)).cast("binary")) % 20
    return df.select(
        df[conv_col].alias("conv_id"), df[turn_col].alias("turn"), F.when(code == 4, "user").otherwise(part(role_col)).alias("role"),
        F.when(code == 1, "").when(code == 2, F.translate(part(text_col), ".!?", "")).otherwise(part(text_col)).alias("text"),
        F.when(code == 0, 0).when(code == 3, 2).otherwise(1).alias("copies"))


def messages(rows: DataFrame) -> DataFrame:
    """(conv, t, role, digest, text, blank, truncated, copies) from conv_id, turn, role, text and copies."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    there = F.col("copies") > 0
    out = rows.select(
        F.col("conv_id").cast("string").alias("conv"),
        F.when(there, F.coalesce(F.col("turn").cast("long"), F.lit(NO_TURN))).otherwise(NO_TURN).alias("t"),
        F.when(there, role).otherwise("").alias("role"), F.when(there, text).otherwise("").alias("text"),
        F.col("copies").cast("long").alias("copies"))
    shown = F.rtrim(F.col("text"), F.lit(SPACE))
    return out.withColumns({"digest": F.unhex(F.sha2("text", 256)), "blank": shown == "",
                            "truncated": ~F.right(shown, F.lit(1)).isin(".", "!", "?")})


def symbols(rows: DataFrame) -> DataFrame:
    """One row per (conv, t, role, digest) with its number and whether role and text were there before."""
    key = ["conv", "t", "role", "digest", "blank", "truncated", F.expr("copies > 0").alias("there")]
    counted = written(rows.groupBy(*key).agg(F.sum("copies").alias("n")), "repair-symbols")
    again = counted.filter("there").groupBy("conv", "role", "digest").agg(
        F.min("t").alias("first_t"), F.count("*").alias("turns")).filter("turns > 1")
    again = written(again, "repair-again").withColumnsRenamed({"conv": "a_conv", "role": "a_role", "digest": "a_digest"})
    same = F.col("conv").eqNullSafe(F.col("a_conv")) & (F.col("role") == F.col("a_role")) & (F.col("digest") == F.col("a_digest"))
    return counted.join(again, same, "left").select(
        "conv", "t", "role", "digest", "blank", "truncated", "n", F.expr("coalesce(t > first_t, false)").alias("seen"))


PIECE_SCHEMA = ("conv string, t long, role string, digest binary, whole boolean, audit string, live string, cost long, "
                "runs array<long>, matrix array<long>, first_initial string, last_initial string, first_turn long, "
                "last_turn long, " + ", ".join(f"{s} long" for s in STATS))


class Piece:
    """The messages of a conversation in one partition, as runs and counts."""

    def __init__(self, conv: str | None, t: int, role: str, digest: bytes):
        self.at = (conv, t, role, digest)
        self.runs: list[list[int]] = []
        self.stats = dict.fromkeys(STATS, 0)
        self.first: str | None = None
        self.last: str | None = None
        self.first_turn: int | None = None
        self.last_turn: int | None = None

    def add(self, t: int, role: str, blank: bool, truncated: bool, seen: bool, n: int) -> None:
        if not n:
            return
        initial = role[:1]
        if t != NO_TURN and t != self.last_turn:
            self.stats["distinct"] += 1
            self.first_turn = t if self.first_turn is None else self.first_turn
            self.last_turn = t
        if self.last is not None:
            self.stats["illegal"] += is_illegal(self.last, initial)
        else:
            self.first = initial
        self.stats["illegal"] += (n - 1) * is_illegal(initial, initial)
        self.last = initial
        alive = 0 if blank or seen else 1
        self.stats["blank" if blank else "duplicate"] += n - alive
        self.stats["truncated"] += alive * truncated
        if alive:
            self._run(symbol_of(initial, truncated), 1)
        if n > alive:
            self._run(DEAD, n - alive)

    def _run(self, symbol: int, count: int) -> None:
        if self.runs and self.runs[-1][0] == symbol:
            self.runs[-1][1] += count
        else:
            self.runs.append([symbol, count])

    def row(self, repairer: Repairer, whole: bool) -> dict:
        conv, t, role, digest = self.at
        out = {"conv": conv, "t": t, "role": role, "digest": digest, "whole": whole, "first_initial": self.first,
               "last_initial": self.last, "first_turn": self.first_turn, "last_turn": self.last_turn, **self.stats}
        if whole:
            out["audit"], out["live"], out["cost"] = repairer.whole(self.runs)
        else:
            out["runs"] = [x for run in self.runs for x in run]
            out["matrix"] = [x for line in repairer.product(self.runs) for x in line]
        return out


def is_illegal(a: str, b: str) -> bool:
    return a + b not in ("su", "ua", "au")


def _arrow(schema: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary(),
             "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}
    return pa.schema([(name, kinds[kind]) for name, kind in (f.split() for f in schema.split(", "))])


def _in_batches(rows: Iterator[dict], schema: str, size: int = 4096) -> Iterator[pa.RecordBatch]:
    held, kind = [], _arrow(schema)
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_pylist(held, kind)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, kind)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    repairer = Repairer()

    def rows() -> Iterator[dict]:
        piece, is_first = None, True
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("conv", "t", "role", "digest", "blank", "truncated", "seen", "n")]
            for conv, t, role, digest, blank, truncated, seen, n in zip(*columns):
                if piece is None or piece.at[0] != conv:
                    if piece is not None:
                        yield piece.row(repairer, not is_first)
                        is_first = False
                    piece = Piece(conv, t, role, digest)
                piece.add(t, role, blank, truncated, seen, n)
        if piece is not None:
            yield piece.row(repairer, False)

    yield from _in_batches(rows(), PIECE_SCHEMA)


ORDER = ["t", "role", "digest"]


def _in_order(pieces: pd.DataFrame) -> pd.DataFrame:
    """Like Spark's order: strings by their UTF-8 bytes."""
    keys = [(t, role.encode(), bytes(digest)) for t, role, digest in zip(pieces["t"], pieces["role"], pieces["digest"])]
    return pieces.iloc[sorted(range(len(keys)), key=keys.__getitem__)]


def _costs_at_ends(pieces: pd.DataFrame) -> pd.DataFrame:
    """Costs to go at the end of each piece of a conversation, from the products of those after it."""
    pieces = _in_order(pieces)
    ends, after = [], Repairer().at_end
    for flat in reversed(pieces["matrix"].tolist()):
        ends.append(list(after))
        flat = [int(x) for x in flat]
        after = onto(tuple(tuple(flat[4 * i:4 * i + 4]) for i in range(4)), after)
    out = pieces[["conv", *ORDER]].copy()
    out["ending"] = ends[::-1]
    out["cost"] = after[START]
    return out


WAY_SCHEMA = ("conv string, t long, role string, digest binary, cost long, audits array<string>, lives array<string>, "
              "exits array<long>")


def _ways(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The choices of each piece for every state in which it may be entered."""
    repairer = Repairer()

    def rows() -> Iterator[dict]:
        for batch in batches:
            for row in batch.to_pylist():
                runs = list(zip(row["runs"][::2], row["runs"][1::2]))
                found = [repairer.unroll(runs, tuple(row["ending"]), state) for state in range(4)]
                yield {**{c: row[c] for c in ("conv", *ORDER, "cost")}, "audits": [f[0] for f in found],
                       "lives": [f[1] for f in found], "exits": [f[2] for f in found]}

    yield from _in_batches(rows(), WAY_SCHEMA, 1)


RESULT_SCHEMA = "conv string, audit string, live string, cost long, gaps long, blank long, duplicate long, truncated long, illegal long"


def _joined(pieces: pd.DataFrame) -> pd.DataFrame:
    """One row for a conversation from its pieces."""
    pieces = _in_order(pieces)
    state, audit, live = START, [], []
    for audits, lives, exits in zip(pieces["audits"], pieces["lives"], pieces["exits"]):
        audit.append(audits[state])
        live.append(lives[state])
        state = int(exits[state])
    ending = Repairer().ending(state)
    sums = {s: int(pieces[s].sum()) for s in STATS}
    first_turn = last_turn = last = None
    for a, b, c, d in zip(*(pieces[c].tolist() for c in ("first_initial", "last_initial", "first_turn", "last_turn"))):
        if isinstance(a, str):
            sums["illegal"] += last is not None and is_illegal(last, a)
            last = b
        if not pd.isna(c):
            sums["distinct"] -= last_turn is not None and int(c) == last_turn
            first_turn, last_turn = int(c) if first_turn is None else first_turn, int(d)
    gaps = 0 if first_turn is None else last_turn - first_turn + 1 - sums.pop("distinct")
    return pd.DataFrame([{"conv": pieces["conv"].iloc[0], "audit": "".join(audit) + ending, "live": "".join(live) + ending,
                          "cost": int(pieces["cost"].iloc[0]), "gaps": gaps,
                          **{s: sums[s] for s in STATS[:4]}}])


def repairs(symbol_rows: DataFrame) -> DataFrame:
    """(conv, audit, live, cost, gaps, blank, duplicate, truncated, illegal), one row per conversation."""
    symbol_rows = written(symbol_rows, "repair-rows")
    dealt = symbol_rows.repartitionByRange("conv", *ORDER).sortWithinPartitions("conv", *ORDER)
    pieces = written(dealt.mapInArrow(_pieces, PIECE_SCHEMA), "repair-pieces")
    edges = pieces.filter("NOT whole")
    kinds = "conv string, t long, role string, digest binary"
    ends = edges.groupBy("conv").applyInPandas(_costs_at_ends, f"{kinds}, ending array<long>, cost long")
    ends = written(ends, "repair-ends").withColumnsRenamed({c: f"e_{c}" for c in ("conv", *ORDER)})

    def same(prefix: str) -> Column:
        return F.col("conv").eqNullSafe(F.col(f"{prefix}_conv")) & F.expr(" AND ".join(f"{c} = {prefix}_{c}" for c in ORDER))

    ways = edges.drop("cost").join(ends, same("e")).select("conv", *ORDER, "cost", "runs", "ending")
    with batches_of(symbol_rows.sparkSession, 16):
        ways = written(ways.mapInArrow(_ways, WAY_SCHEMA), "repair-ways")
    ways = ways.withColumnsRenamed({c: f"w_{c}" for c in ("conv", *ORDER)})
    joined = edges.drop("audit", "live", "cost", "runs", "matrix").join(ways, same("w")).drop("w_conv", *[f"w_{c}" for c in ORDER])
    joined = joined.groupBy("conv").applyInPandas(_joined, RESULT_SCHEMA)
    gaps = F.coalesce(F.col("last_turn") - F.col("first_turn") + 1 - F.col("distinct"), F.lit(0)).cast("long")
    return pieces.filter("whole").select("conv", "audit", "live", "cost", gaps.alias("gaps"), *STATS[:4]).unionByName(joined)


def first_texts(rows: DataFrame) -> DataFrame:
    """Every message that isn't blank where it comes first, with its text."""
    return rows.filter("copies > 0 AND NOT blank").groupBy("conv", "role", "text").agg(F.min("t").alias("t"))


def _streamed(emit: Callable[[dict, Iterator[tuple[str, str]]], Iterator[dict]], schema: str):
    """A function over sorted rows: a header of each conversation, then its messages."""
    def lines(live: str, texts: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str]]:
        state = START
        for edit in live:
            role, text = ("", "") if edit == "I" else next(texts)
            if edit == "D":
                continue
            if edit == "K":
                state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[role[:1]]
            else:
                state = NEXT[state]
                role = ROLES[state]
            yield role, text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ahead: list[dict] = []

        def flat() -> Iterator[dict]:
            for batch in batches:
                yield from batch.to_pylist()

        source = flat()

        def texts() -> Iterator[tuple[str, str]]:
            for row in source:
                if row["kind"] == 0:
                    ahead.append(row)
                    return
                yield row["role"], row["text"]

        def rows() -> Iterator[dict]:
            ahead.extend(itertools.islice(source, 1))
            while ahead:
                header = ahead.pop()
                own = texts()
                yield from emit(header, lines(header["live"], own))
                for _ in own:  # up to the next header
                    pass

        yield from _in_batches(rows(), schema, BATCH_ROWS)

    return run


def _with_texts(rows: DataFrame, found: DataFrame) -> DataFrame:
    headers = found.withColumns({"kind": F.lit(0), "t": F.lit(NO_TURN), "role": F.lit(""), "text": F.lit("")})
    texts = first_texts(rows).withColumn("kind", F.lit(1))
    both = headers.unionByName(texts, allowMissingColumns=True).withColumn("digest", F.sha2("text", 256))
    return both.repartition("conv").sortWithinPartitions("conv", "kind", *ORDER)


DIGEST_SCHEMA = "conv string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _digest(header: dict, lines: Iterator[tuple[str, str]]) -> Iterator[dict]:
    total = hashlib.sha256()
    for k, (role, text) in enumerate(lines):
        total.update(f"{chr(10) * (k > 0)}{role}:{text}".encode())
    names = [f.split()[0] for f in DIGEST_SCHEMA.split(", ")][:-1]
    yield {**{c: header[c] for c in names}, "repaired_sha256": total.hexdigest()}


def _turns(header: dict, lines: Iterator[tuple[str, str]]) -> Iterator[dict]:
    for k, (role, text) in enumerate(lines):
        yield {"conv": header["conv"], "turn": k, "role": role, "text": text}


def _run(rows: DataFrame, emit: Callable, schema: str, name: str) -> DataFrame:
    kind = rows.schema["conv_id"].dataType
    own = messages(rows if "copies" in rows.columns else rows.withColumn("copies", F.lit(1)))
    found = written(repairs(symbols(own)), "repairs")
    with batches_of(rows.sparkSession, BATCH_ROWS):
        out = written(_with_texts(own, found).mapInArrow(_streamed(emit, schema), schema), name)
    return out.select(F.col("conv").cast(kind).alias("conv_id"), *out.columns[1:])


def audited(rows: DataFrame) -> DataFrame:
    """Counts of faults, cost, audit and the digest of the repaired text, one row per conversation.

    ``rows`` has conv_id, turn, role, text and, if rows stand for none or several, copies.
    """
    return _run(rows, _digest, DIGEST_SCHEMA, "audited")


def repaired(rows: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, turn (from 0), role, text."""
    return _run(rows, _turns, "conv string, turn long, role string, text string", "repaired")
