"""Tables, JSON rows, the older layout and the writers."""

from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from shoplight.functions.times import trailing
from shoplight.operators.retention import apply_retention
from shoplight.schemas import EVENT_TABLES, LEGACY_TABLES, SORT_KEYS
from shoplight.session import stored, work_dir
from shoplight.sources.rows import read_event_rows, upgrade_layout
from shoplight.sources.sinks import append_batches, export_csv, to_json_rows
from shoplight.sources.tables import load_tables, table_counts

AT = dt.datetime(2025, 1, 15, 10)


def test_declared_tables(spark, tmp_path):
    for name in ("page_views", "search_events"):
        spark.createDataFrame([], EVENT_TABLES[name]).write.parquet(f"{tmp_path}/{name}")
    schemas = {name: EVENT_TABLES[name] for name in ("page_views", "search_events")}
    tables = load_tables(spark, str(tmp_path), schemas)
    assert tables["page_views"].columns == EVENT_TABLES["page_views"].fieldNames()
    assert {r.table_name: r.row_count for r in table_counts(tables).collect()} == {"page_views": 0, "search_events": 0}


def test_bad_json_rows_are_kept(spark, tmp_path):
    lines = [json.dumps({"metric_id": "m", "metric_value": 1.5, "timestamp": "2025-01-15 10:00:00"}), "{broken", json.dumps({"metric_id": "n", "metric_value": "x"})]
    (tmp_path / "rows.json").write_text("\n".join(lines))
    rows = read_event_rows(spark, str(tmp_path), EVENT_TABLES["performance_metrics"]).cache()
    assert rows.filter(F.col("_corrupt_record").isNull()).count() == 1
    assert rows.count() == 3


def test_older_layout(spark):
    row = {
        "user_events": (AT, 7, "click", "/", "s", "1", "x", "{}"), "game_events": (AT, 7, 3, "view", "{}"),
        "purchase_events": (AT, 7, 9, 3, 10, "USD", "paypal", "completed"), "performance_metrics": (AT, "web", "/", 45, 200, None),
    }
    out = {}
    for name, schema in LEGACY_TABLES.items():
        values = spark.createDataFrame([tuple(str(v) if v is not None else None for v in row[name])], ", ".join(f"{f} string" for f in schema.fieldNames()))
        typed = values.select(*[F.col(f.name).cast(f.dataType) for f in schema.fields])
        out[name] = upgrade_layout(typed, name).first()
    assert out["user_events"].user_id == "7" and out["game_events"].event_type == "view"
    assert (out["purchase_events"].order_id, str(out["purchase_events"].total_amount), out["purchase_events"].status) == ("9", "10.00", "completed")
    assert (out["performance_metrics"].metric_type, out["performance_metrics"].metric_value) == ("response_time", 45.0)
    with pytest.raises(ValueError):
        upgrade_layout(spark.range(1), "unknown")


def test_append_reports_rows_and_batches(spark, tmp_path):
    df = spark.range(2501).select("id", (F.lit(AT) + F.make_dt_interval(F.lit(0), (F.col("id") % 50).cast("int"))).alias("timestamp"))
    path = f"{tmp_path}/t"
    assert append_batches(df, path) == {"rows": 2501}
    assert append_batches(df.limit(0), path) == {"rows": 0}
    assert append_batches(df.limit(10), path) == {"rows": 10}
    back = spark.read.parquet(path)
    assert back.count() == 2511 and back.select("event_date").distinct().count() == 3


def test_partitions_are_found_beside_a_declared_schema(spark, tmp_path):
    schema = EVENT_TABLES["page_views"]
    rows = spark.range(100).select(*[
        (F.lit(AT) + F.make_dt_interval((F.col("id") % 5).cast("int"))).cast("timestamp").alias(f.name) if f.name == "timestamp"
        else F.col("id").cast("string").alias(f.name) if f.name in ("event_id", "session_id")
        else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields
    ])
    append_batches(rows, f"{tmp_path}/page_views", sort_by=SORT_KEYS["page_views"])
    table = load_tables(spark, str(tmp_path), {"page_views": schema})["page_views"]
    recent = trailing(table, "timestamp", "1 DAY", AT + dt.timedelta(days=4))
    assert recent.count() == 40 and len(recent.inputFiles()) >= 1
    assert recent.select("event_date").distinct().count() == 2
    with pytest.raises(ValueError):
        append_batches(rows, f"{tmp_path}/x", ts="created_at")


def test_late_rows_survive_retention_on_partitioned_tables(spark, tmp_path):
    """Rows age by ``created_at``; the event date must not decide."""
    at = dt.datetime(2023, 1, 1)
    rows = spark.createDataFrame([(at, dt.datetime(2024, 6, 1)), (at, dt.datetime(2023, 1, 2))], "timestamp timestamp_ntz, created_at timestamp_ntz")
    append_batches(rows, f"{tmp_path}/t")
    kept = apply_retention(spark.read.parquet(f"{tmp_path}/t"), "page_views", dt.datetime(2024, 6, 2))
    assert kept.count() == 1


def test_csv_export_replaces_its_day(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ('with "quotes", and comma', None)], "s string, n int")
    for _ in range(2):
        path = export_csv(df, str(tmp_path), "page_views", dt.date(2025, 1, 5))
    assert path.endswith("/page_views/2025-01-05")
    assert sorted(map(tuple, spark.read.schema(df.schema).csv(path).collect())) == sorted(map(tuple, df.collect()))


def test_json_rows_keep_nulls(spark):
    df = spark.createDataFrame([(1, None)], "a int, b string")
    assert json.loads(to_json_rows(df).first().json) == {"a": 1, "b": None}


def test_work_folders_are_new_and_follow_the_setting(spark, tmp_path):
    before = spark.conf.get("spark.checkpoint.dir", None)
    first, second = work_dir(spark, "x"), work_dir(spark, "x")
    assert first != second
    if before:
        assert first.startswith(before)


def test_stored_frames_come_back_whole(spark):
    df = spark.range(100).withColumn("v", F.col("id") * 2)
    assert stored(df, "test").agg(F.sum("v")).first()[0] == 9900
