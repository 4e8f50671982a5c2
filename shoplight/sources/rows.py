"""Event rows in newline-JSON form and the older event layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def read_event_rows(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Rows from newline-JSON files; a line that does not fit is kept in ``_corrupt_record``."""
    schema = StructType([*schema.fields, StructField("_corrupt_record", StringType())])
    return (
        spark.read.schema(schema)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt_record")
        .json(path)
    )


def upgrade_layout(df: DataFrame, table: str) -> DataFrame:
    """Rows of an older-layout table in the column names and types of the current one."""
    text_id = lambda name: F.col(name).cast("string").alias(name)
    if table == "user_events":
        return df.select(
            "session_id", text_id("user_id"), "page_url", F.col("event_type").alias("action_type"),
            F.col("metadata").alias("event_data"), "timestamp", "ip_address", "user_agent",
        )
    if table == "game_events":
        return df.select(
            text_id("user_id"), "game_id", "event_type", F.col("metadata").alias("event_data"), "timestamp",
        )
    if table == "purchase_events":
        return df.select(
            text_id("user_id"), text_id("order_id"), "game_id", F.lit(1).alias("quantity"),
            F.col("amount").alias("total_amount"), "currency", "payment_method",
            F.col("timestamp").alias("purchase_timestamp"), F.lit("purchase").alias("funnel_step"), "status",
        )
    if table == "performance_metrics":
        return df.select(
            "service_name", F.lit("response_time").alias("metric_type"),
            F.col("response_time").cast("double").alias("metric_value"), F.lit("ms").alias("unit"),
            "endpoint", "status_code", "error_message", "timestamp",
        )
    raise ValueError(f"no older layout for {table!r}")
