"""Mixing sources to target weights by systematic sampling.

Each source gets a share of a word budget by weight, at most ``max_copies``
times its own words; what is cut off goes to the others by weight. Every
document of a source then expects the same number of copies (target / words).
The expected copies are prefix-summed within the source in an order by size
class, one random offset per source is added, and a document is emitted once
per integer that its step of the running sum crosses. Neighbours in the order
have similar sizes, so the words taken stay near the target.

Running sums are whole numbers (units of 1 / 2**24 copy), so results do not
depend on the order of additions. No window spans a source: rows are numbered
inside cells (source, size class, hash bucket), and the cells, which are
counted first, carry the offsets. The number of hash buckets follows the
counted rows, so a cell stays small at any size of the table or of a source.

Null text counts as empty (size 0), a null source is a source of its own and
comes last. Rows that repeat an id are documents of their own. If no document
has a word, nothing is taken. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from softgrove.llm.common import n_words, written

UNIT_BITS = 24
UNIT = 1 << UNIT_BITS
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_COPIES = 2.0
CELL_ROWS = 20_000


def size_class() -> Column:
    """Four classes of ``__size`` for each doubling."""
    return F.expr("CASE WHEN __size < 4 THEN __size ELSE 4 * length(bin(__size)) + "
                  "(shiftright(__size, length(bin(__size)) - 3) & 3) END").cast("long")


def draw(*parts: Column) -> Column:
    """A whole number below 2**32 from an md5 of the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts).cast("binary")), 1, 8), 16, 10).cast("long")


def cells_of(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int, n_buckets: int) -> DataFrame:
    """The documents with size, class and bucket, under names that do not clash."""
    id_text = F.coalesce(docs[id_col].cast("string"), F.lit(""))
    rows = docs.withColumns({
        "__size": n_words(docs[text_col]),
        "__source": F.concat(F.when(docs[source_col].isNull(), "1").otherwise("0"),
                             F.coalesce(docs[source_col].cast("string"), F.lit(""))),
        "__draw": draw(F.lit(f"{seed}"), id_text)})
    return rows.withColumns({"__class": size_class(), "__bucket": F.col("__draw") % n_buckets})


def targets(sources: DataFrame, weights: tuple[int, ...], share: float, max_copies: float) -> DataFrame:
    """Adds weight and target to (__source, source_size), one row per source.

    A source is full if its cap is at most its share of what the sources with a
    smaller cap per weight leave; the others divide the rest by weight.
    """
    rank = F.row_number().over(Window.orderBy("__source")) - 1
    choices = F.array(*[F.lit(float(w)) for w in weights])
    s = sources.withColumn("weight", F.element_at(choices, (rank % len(weights) + 1).cast("int")))
    s = s.withColumn("cap", F.col("source_size") * F.lit(float(max_copies)))
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), "__source")
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    after = by_cap.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumn("budget", F.sum("source_size").over(everything) * F.lit(float(share)))
    s = s.withColumn("left", F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    s = s.withColumn("open_weight", F.sum("weight").over(after))
    s = s.withColumn("full", F.col("cap") * F.col("open_weight") <= F.col("weight") * F.col("left"))
    s = s.withColumn("full_caps", F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0.0)).over(everything))
    s = s.withColumn("open_weights", F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("weight"))).over(everything))
    return s.select("__source", "source_size", F.when(F.col("full"), F.col("cap")).otherwise(
        F.col("weight") * (F.col("budget") - F.col("full_caps")) / F.col("open_weights")).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 7,
        weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, max_copies: float = MAX_COPIES,
        cell_rows: int = CELL_ROWS) -> DataFrame:
    """All documents with ``__size``, ``__source_size``, ``__target`` and ``__copies`` beside their columns."""
    n_buckets = max(1, -(-docs.count() // cell_rows))
    rows = cells_of(docs, id_col, text_col, source_col, seed, n_buckets)
    cell = ["__source", "__class", "__bucket"]
    cells = written(rows.groupBy(*cell).agg(F.count("*").alias("n"), F.sum("__size").alias("words")), "mix-cells")
    sources = targets(cells.groupBy("__source").agg(F.sum("words").alias("source_size")), weights, share, max_copies)
    sources = sources.withColumn("step", F.when(
        F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") * UNIT)).otherwise(0).cast("long"))
    order = Window.partitionBy("__source").orderBy("__class", "__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.withColumn("first", F.coalesce(F.sum("n").over(order), F.lit(0)))
    starts = starts.join(sources, "__source").select(
        *cell, F.col("first").alias("__first"), F.col("step").alias("__step"), F.col("source_size").alias("__source_size"),
        F.col("target").alias("__target"),
        (draw(F.lit(f"{seed}"), F.lit("offset"), F.col("__source")) % UNIT).alias("__offset"))
    in_cell = Window.partitionBy(*cell).orderBy("__size", "__draw", docs[id_col])
    rows = rows.withColumn("__rank", F.row_number().over(in_cell)).join(starts, cell)
    upto = F.col("__offset") + (F.col("__first") + F.col("__rank")) * F.col("__step")
    crossed = F.shiftright(upto, UNIT_BITS) - F.shiftright(upto - F.col("__step"), UNIT_BITS)
    return rows.select(*[rows[c] for c in docs.columns], "__size", "__source_size", "__target",
                       crossed.cast("int").alias("__copies"))


def emitted(mixed: DataFrame) -> DataFrame:
    """One row per copy, with the columns of the documents."""
    own = [c for c in mixed.columns if c not in ("__size", "__source_size", "__target", "__copies")]
    copies = mixed.filter("__copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), "__copies")))
    return copies.select(*own)
