"""The query registry."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, TimestampType

from shoplight.plans.check_views import with_views
from shoplight.session import prepare
from shoplight.sources.shop_views import ShopViews


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[ShopViews], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Register a function of the logical views under ``name``, with its check SQL if there is one."""

    def register(build: Callable[[ShopViews], DataFrame]) -> Callable[[ShopViews], DataFrame]:
        if name in REGISTRY:
            raise ValueError(f"query {name!r} is registered twice")
        REGISTRY[name] = Query(name, build, with_views(sql) if sql else None)
        return build

    return register


def comparable(df: DataFrame) -> DataFrame:
    """Decimals as doubles and instants as zone-less UTC times, as the check SQL returns them."""
    columns = []
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, DecimalType):
            column = column.cast("double").alias(field.name)
        elif isinstance(field.dataType, TimestampType):
            column = column.cast("timestamp_ntz").alias(field.name)
        columns.append(column)
    return df.select(*columns)


def runner(entry: Query) -> Callable[[SparkSession, str], DataFrame]:
    """The query as a function of a session and a data folder."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return comparable(entry.build(ShopViews(prepare(spark), sf_dir)))

    return run
