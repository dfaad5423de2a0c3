"""Named data sources: register a reader once, load it by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Reader = Callable[[SparkSession], DataFrame]
_SOURCES: dict[str, Reader] = {}


def register_source(name: str, reader: Reader) -> None:
    _SOURCES[name] = reader


def load_source(spark: SparkSession, name: str) -> DataFrame | None:
    """The table of a registered name or of the catalog; None if there is neither."""
    if name in _SOURCES:
        return _SOURCES[name](spark)
    if spark.catalog.tableExists(name):
        return spark.table(name)
    return None


def source_names() -> list[str]:
    return sorted(_SOURCES)
