"""Secret scan with corpus-wide ownership frequency.

Patterns find spans in every whole text. All spans the patterns find are kept;
besides them, long tokens of letters and digits are candidates. The hashes of all
found values are then aggregated over the corpus by distinct repositories and
owners: a value is a copied example if ``example_owners`` owners have it, or if it
lies in ``example_repos`` repositories, be it of one owner; else it looks live.
Candidates that look live are added as spans of kind ``token``, and each span
carries both counts and its verdict. Without a column of repositories, each
document is one.

The texts are scanned once, into a narrow table of spans in the shared folder;
hashes are counted with map-side aggregation, and joined back by hash, whose
hot values the adaptive skew join splits.

Null text counts as empty. Rows that repeat an id are scanned and returned one
by one; they count as one repository. A null owner is an owner of its own. An
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from softgrove.llm.common import small_batches, written

#: kinds in the order in which spans that start together are listed
KINDS = ("assign", "access", "hex", "token")
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
MIN_VALUE = 6
MIN_ENTROPY = 3.2
#: owners, and repositories, from which on a value is a copied example
EXAMPLE_OWNERS = 3
EXAMPLE_REPOS = 12

SPANS = T.ArrayType(T.StructType([
    T.StructField("kind", T.ByteType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()),
    T.StructField("hash", T.StringType())]))


def entropy(value: str) -> float:
    """Bits per character."""
    n = len(value)
    return -sum(k / n * math.log2(k / n) for k in (value.count(c) for c in set(value)))


def mixed(value: str) -> bool:
    """Letters and digits, without much repetition."""
    return any(c.isalpha() for c in value) and any(c.isdigit() for c in value) and entropy(value) >= MIN_ENTROPY


def find(text: str) -> list[tuple[int, int, int, str]]:
    """(kind, start, end, value) of the pattern spans, by start and kind, then of the candidates."""
    out = []
    if ":" in text or "=" in text:
        out += [(0, *m.span(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_VALUE]
    if "AKIA" in text:
        out += [(1, *m.span(), m[0]) for m in ACCESS.finditer(text)]
    out += [(2, *m.span(), m[0]) for m in HEX.finditer(text)]
    out.sort(key=lambda x: (x[1], x[0]))
    taken = [(s, e) for _, s, e, _ in out]
    for m in TOKEN.finditer(text):
        s, e = m.span()
        if mixed(m[0]) and not any(a < e and s < b for a, b in taken):
            out.append((3, s, e, m[0]))
    return out


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source",
         repo_col: str | None = None) -> DataFrame:
    """One row per document: id, owner, repo, found (spans with the sha256 of their value)."""
    small_batches(docs.sparkSession)
    rows = docs.select(docs[id_col].alias("id"), docs[owner_col].alias("owner"),
                       docs[repo_col or id_col].alias("repo"), docs[text_col].alias("text"))
    schema = T.StructType([rows.schema["id"], rows.schema["owner"], rows.schema["repo"], T.StructField("found", SPANS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.int8()), ("start", pa.int32()), ("end", pa.int32()),
                                   ("hash", pa.string())]))
        for batch in batches:
            found = [[{"kind": k, "start": s, "end": e, "hash": hashlib.sha256(v.encode()).hexdigest()[:32]}
                      for k, s, e, v in find(t)] if t else [] for t in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found, kind)],
                                             names=["id", "owner", "repo", "found"])

    return rows.mapInArrow(run, schema)


def ownership(spans: DataFrame) -> DataFrame:
    """hash, n_owners, n_repos from (hash, owner, repo): distinct in two steps, each with map-side aggregation."""
    repos = spans.groupBy("hash", "owner", "repo").agg(F.lit(1).alias("one"))
    owners = repos.groupBy("hash", "owner").agg(F.count("*").alias("repos"))
    return owners.groupBy("hash").agg(F.count("*").alias("n_owners"), F.sum("repos").alias("n_repos"))


def n_of(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(name, s["kind"].cast("int") + 1), s["start"], s["end"])), ",")


def verdicts(spans: Column) -> Column:
    """live or example for each span, comma-joined in their order."""
    return F.array_join(F.transform(spans, lambda s: F.when(s["live"], "live").otherwise("example")), ",")


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source",
            repo_col: str | None = None, example_owners: int = EXAMPLE_OWNERS, example_repos: int = EXAMPLE_REPOS) -> DataFrame:
    """One row per document: id, base (pattern spans) and spans (all), each with kind, start, end, hash, n_owners,
    n_repos and live, and the numbers of examples and of live spans."""
    found = scan(docs, id_col, text_col, owner_col, repo_col).withColumn("row", F.monotonically_increasing_id())
    found = written(found, "secret-spans")
    each = found.filter(F.size("found") > 0).select("row", "owner", "repo", F.explode("found").alias("s"))
    each = each.select("row", "owner", "repo", "s.*")
    counted = written(ownership(each).select(F.col("hash").alias("value"), "n_owners", "n_repos"), "secret-owners")
    joined = each.join(counted, each["hash"] == counted["value"])
    joined = joined.withColumn("live", (F.col("n_owners") < example_owners) & (F.col("n_repos") < example_repos))
    joined = joined.filter((F.col("kind") < KINDS.index("token")) | F.col("live"))
    per_row = joined.groupBy("row").agg(F.array_sort(F.collect_list(
        F.struct("start", "kind", "end", "hash", "n_owners", "n_repos", "live"))).alias("spans"))
    none = F.array().cast(per_row.schema["spans"].dataType)
    out = found.select("row", "id").join(per_row, "row", "left").select(
        "id", F.coalesce("spans", none).alias("spans"))
    return out.select("id", F.filter("spans", lambda s: s["kind"] < KINDS.index("token")).alias("base"), "spans",
                      F.size(F.filter("spans", lambda s: ~s["live"])).alias("n_examples"),
                      F.size(F.filter("spans", lambda s: s["live"])).alias("n_live"))
