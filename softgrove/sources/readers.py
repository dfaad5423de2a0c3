"""Readers for the table formats of classification data, each with an explicit schema.

Every reader returns a DataFrame whose last column is the target. None of them
infers a schema: that would cost a second pass over the files.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from softgrove.functions.encode import recode
from softgrove.functions.sqltext import name
from softgrove.operators.prepare import encode_first_seen


BROADCAST_BLOCKS = 200_000


def _file_order() -> list:
    """Place of a line: file, start of its block, and a number that rises within the block."""
    return [F.expr("_metadata.file_path AS __file"), F.expr("_metadata.file_block_start AS __block"),
            F.monotonically_increasing_id().alias("__line")]


def target_last(df: DataFrame, target: str) -> DataFrame:
    return df.select(*[c for c in df.columns if c != target], target)


def split_target(df: DataFrame) -> tuple[list[str], str]:
    """Feature names and target name of a table whose last column is the target."""
    return df.columns[:-1], df.columns[-1]


def features_as_double(df: DataFrame) -> DataFrame:
    features, target = split_target(df)
    return df.select(*[F.col(f).cast("double").alias(f) for f in features], target)


def read_csv_header(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header; rows with missing values are dropped."""
    return spark.read.csv(path, schema=schema, header=True).na.drop()


def read_csv_plain(spark: SparkSession, path: str | Sequence[str], schema: str, target: str | None = None) -> DataFrame:
    """CSV without a header; ``target`` is moved last if it is not there."""
    paths = [path] if isinstance(path, str) else list(path)
    df = spark.read.csv(paths, schema=schema, header=False)
    return df if target is None else target_last(df, target)


def _split_text(spark: SparkSession, paths: str | Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Fields parted by any number of blanks, leading and trailing ones ignored."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    lines = spark.read.text(paths).filter("trim(value) <> ''")
    fields = lines.select(F.split(F.trim("value"), " +").alias("f"))
    return fields.select(*[F.get("f", F.lit(i)).alias(c) for i, c in enumerate(columns)])


def read_blank_separated(spark: SparkSession, paths: str | Sequence[str], columns: Sequence[str],
                         recoding: Mapping[str, int] | None = None) -> DataFrame:
    """Several blank-separated files as one table: integers, the last column recoded by a mapping."""
    df = _split_text(spark, paths, columns)
    target = columns[-1]
    label = recode(F.col(target), recoding) if recoding else F.col(target)
    return df.select(*[F.col(c).cast("int").alias(c) for c in columns[:-1]], label.cast("int").alias(target))


def read_arff(spark: SparkSession, path: str, recoding: Mapping[str, int] | None = None) -> DataFrame:
    """ARFF: attribute lines give names and types, the rest is CSV.

    Only the header lines (a few per file) are looked at on the driver. Several
    files must have the same attributes.
    """
    lines = spark.read.text(path).select(F.trim("value").alias("value"), *_file_order()).filter("value <> ''")
    head = lines.filter("lower(value) LIKE '@attribute%'").select(
        "__file", "__block", "__line",
        F.regexp_extract("value", r"(?i)^@attribute\s+('[^']+'|\S+)\s+(.+)$", 1).alias("name"),
        F.regexp_extract("value", r"(?i)^@attribute\s+('[^']+'|\S+)\s+(.+)$", 2).alias("kind")).orderBy("__file", "__block", "__line").collect()
    by_file: dict[str, list] = {}
    for r in head:
        by_file.setdefault(r["__file"], []).append((r["name"], r["kind"].strip().lower()))
    if len({tuple(x) for x in by_file.values()}) > 1:
        raise ValueError("the files have different attributes")
    head = [r for r in head if r["__file"] == head[0]["__file"]]
    numeric = ("real", "numeric", "integer")
    schema = ", ".join(f"{name(r['name'].strip(chr(39)))} "
                       f"{'double' if r['kind'].strip().lower() in numeric else 'string'}" for r in head)
    body = lines.filter("NOT startswith(value, '%') AND NOT startswith(value, '@')")
    df = body.select(F.from_csv("value", schema, {"ignoreLeadingWhiteSpace": "true", "quote": "'"}).alias("r")).select("r.*")
    if not recoding:
        return df
    target = df.columns[-1]
    return df.withColumn(target, recode(F.col(target), recoding))


def read_categorical_csv(spark: SparkSession, path: str, columns: Sequence[str], target: str) -> DataFrame:
    """Headerless CSV of categories: every column coded 0, 1, .. by first appearance, target last.

    The order of appearance is the position in the file set (file name, then line).
    """
    schema = ", ".join(f"{name(c)} string" for c in columns)
    df = spark.read.csv(path, schema=schema, header=False).select("*", *_file_order())
    blocks = df.select("__file", "__block").distinct().withColumn(
        "__number", F.row_number().over(Window.orderBy("__file", "__block")))  # a row per block of a file
    blocks = F.broadcast(blocks) if blocks.count() <= BROADCAST_BLOCKS else blocks
    # Spark packs blocks into tasks by size; inside a block the row numbers of a task rise with the lines
    df = df.join(blocks, ["__file", "__block"]).withColumn(
        "__at", F.shiftleft(F.col("__number").cast("bigint"), 33) + F.col("__line").bitwiseAND(F.lit((1 << 33) - 1)))
    df = df.drop("__file", "__block", "__number", "__line")
    coded = encode_first_seen(df, list(columns), "__at").drop("__at")
    return target_last(coded, target)
