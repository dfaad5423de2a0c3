"""Store result tables by run and read a chosen or the latest run back."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RUN_FORMAT = "%Y%m%d%H%M%S%f"


def write_results(df: DataFrame, path: str, fmt: str = "parquet", run_ts: str | None = None) -> str:
    """Append the rows as one run (partition ``run_ts``) and return its name.

    A second write of the same run replaces only that run. The folder name has a
    letter before the run, so that a run like 007 is not read as a number.
    """
    run_ts = run_ts or datetime.now(timezone.utc).strftime(RUN_FORMAT)
    writer = df.withColumn("run_ts", F.lit(f"r{run_ts}")).write.partitionBy("run_ts").mode("overwrite")
    writer = writer.option("partitionOverwriteMode", "dynamic")
    (writer.option("header", True).csv(path) if fmt == "csv" else writer.parquet(path))
    return run_ts


def read_results(spark: SparkSession, path: str, fmt: str = "parquet", run_ts: str | None = None,
                 schema: str | None = None) -> DataFrame:
    """Rows of one run, by default of the latest; only its partition is read."""
    reader = spark.read.option("header", True) if fmt == "csv" else spark.read
    if schema:
        reader = reader.schema(f"{schema}, run_ts string")
    df = reader.format(fmt).load(path).withColumn("run_ts", F.expr("substring(run_ts, 2)"))
    if run_ts is None:
        run_ts = df.agg(F.max("run_ts").alias("r")).first()["r"]
    return df.filter(F.col("run_ts") == run_ts)
