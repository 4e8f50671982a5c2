"""Typed tables and their row counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from shoplight.schemas import EVENT_TABLES, SHOP_TABLES


def load_tables(
    spark: SparkSession, root: str, schemas: dict[str, StructType] | None = None, suffix: str = ""
) -> dict[str, DataFrame]:
    """One DataFrame per table below ``root``, read with its declared schema.

    With a declared schema no file is opened to infer one, and only the columns a query uses
    are read. A table is a folder of parquet files or, with ``suffix=".parquet"``, one file.
    """
    schemas = {**EVENT_TABLES, **SHOP_TABLES} if schemas is None else schemas
    return {name: spark.read.schema(schema).parquet(f"{root}/{name}{suffix}") for name, schema in schemas.items()}


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows per table as ``(table_name, row_count)``; one row per table leaves each scan."""
    counts = [df.agg(F.count("*").alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
              for name, df in sorted(tables.items())]
    return reduce(DataFrame.unionByName, counts)
