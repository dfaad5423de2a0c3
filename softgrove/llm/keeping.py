"""Keep one row of each group of duplicates, without moving texts where the others are few."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from softgrove.llm.common import written

#: Dropped rows (an id and a hash each) up to which they are broadcast; more are joined by shuffle.
LISTED = 1_000_000


def stay(docs: DataFrame, member: DataFrame, id_col: str, text_hash: Column) -> DataFrame:
    """The rows of ``docs`` that stay by ``member`` (id, text_hash, keep_id, keep_hash), with their columns."""
    stays = F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("text_hash") == F.col("keep_hash"))
    dropped = member.filter(~stays).select(F.col("id").alias("__id"), F.col("text_hash").alias("__drop")).distinct()
    dropped = written(dropped, "dropped")
    if dropped.limit(LISTED + 1).count() <= LISTED:
        dropped = F.broadcast(dropped)
    marked = docs.withColumn("__hash", text_hash)
    kept = marked.join(dropped, marked[id_col].eqNullSafe(dropped["__id"]) & (marked["__hash"] == dropped["__drop"]),
                       "left_anti")
    again = member.filter(stays).groupBy("id", "text_hash").count().filter("count > 1")
    if not again.isEmpty():
        again = written(again.select(F.col("id").alias("__id"), F.col("text_hash").alias("__again")), "repeated")
        same = kept[id_col].eqNullSafe(again["__id"]) & (kept["__hash"] == again["__again"])
        kept = kept.join(again, same, "left_anti").unionByName(
            kept.join(again, same, "left_semi").dropDuplicates([id_col, "__hash"]))
    return kept.select(*[kept[c] for c in docs.columns])
