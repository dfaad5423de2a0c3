"""Exact duplicates by progressive refinement: length, then prefix hash, then full hash.

Every pass is a scan with map-side counting. A row takes part in the next,
dearer pass only if another row shares its key so far. Which keys are shared is
handed to the next scan as a set of hash slots with a fixed upper size, so the
texts themselves are never shuffled; a slot shared by chance only costs work.

Null text counts as empty. Rows that repeat both id and text come back one by
one from ``membership``, and ``group_size`` counts each of them; ``keep_one``
keeps one of them. A null id is an id of its own, and stays only if the whole group has none. Other columns are
not looked at. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from softgrove.llm.common import written
from softgrove.llm.keeping import stay

SLOTS = 1 << 20
PREFIX_CHARS = 256


def _slot(key: list[Column]) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(SLOTS)).cast("int")


def _shared(rows: DataFrame, key: list[str]) -> DataFrame:
    """Slots of the keys that more than one row has: at most SLOTS rows of one int."""
    counted = rows.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1")
    return counted.select(_slot([F.col(k) for k in key]).alias("slot")).distinct()


def _refine(rows: DataFrame, key: list[str]) -> DataFrame:
    shared = F.broadcast(_shared(rows, key))
    return rows.withColumn("slot", _slot([F.col(k) for k in key])).join(shared, "slot", "left_semi").drop("slot")


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """(id, text_hash, sha256) of the rows that share length and prefix with another."""
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("own"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    rows = rows.withColumn("length", F.octet_length("text"))
    rows = _refine(rows, ["length"])
    rows = rows.withColumn("head", F.xxhash64(F.substring("text", 1, prefix_chars)))
    rows = _refine(rows, ["length", "head"])
    return rows.select("id", F.xxhash64("own").alias("text_hash"), F.sha2("text", 256).alias("sha256"))


def equal_groups(rows: DataFrame) -> DataFrame:
    """One row per text that several of the candidates have: sha256, keep_id, keep_hash, group_size, repeated.

    ``keep_id`` is the largest id; ``repeated`` says that rows of the group share an id.
    """
    per_id = rows.groupBy("sha256", "id").agg(F.count("*").alias("n"), F.max("text_hash").alias("text_hash"))
    keep = F.max(F.struct(F.col("id").isNotNull(), "id", "text_hash"))
    return per_id.groupBy("sha256").agg(
        keep.alias("keep"), F.sum("n").alias("group_size"), (F.max("n") > 1).alias("repeated")
    ).filter("group_size > 1").select("sha256", F.col("keep.id").alias("keep_id"), F.col("keep.text_hash").alias("keep_hash"),
                                      "group_size", "repeated")


def membership(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, sha256, keep_id, group_size, kept, repeated.

    The digest of every text is asked for here, so it is computed in the scan;
    the groups come from the refinement. They are joined by digest, whose hot
    values the adaptive skew join splits.
    """
    groups = written(equal_groups(candidates(docs, id_col, text_col)), "equal-groups")
    rows = docs.select(docs[id_col].alias("id"), F.sha2(F.coalesce(docs[text_col], F.lit("")), 256).alias("sha256"))
    single = F.col("group_size").isNull()
    return rows.join(groups, "sha256", "left").select(
        "id", "sha256",
        F.when(single, F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (single | F.col("id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        F.coalesce("repeated", F.lit(False)).alias("repeated"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with their columns: one of each group of equal texts.

    Groups come from the refined rows alone; the rows to drop are taken out by id and hash of the text.
    """
    rows = written(candidates(docs, id_col, text_col), "equal-candidates")
    groups = written(equal_groups(rows), "equal-groups")
    member = rows.join(groups, "sha256").select("id", "text_hash", "keep_id", "keep_hash")
    return stay(docs, written(member, "equal-members"), id_col, F.xxhash64(docs[text_col]))
