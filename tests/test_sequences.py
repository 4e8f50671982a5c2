"""Ordered sequences, with and without a key that holds a third of all rows."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from shoplight.operators.sequences import (
    behavior_flow, conversion_time, enrich_visits, growth_rate, in_chunks, latest_by_key, sessionise, status_history,
    with_neighbours,
)

START = dt.datetime(2024, 1, 1)


def clicks(seed: int, burst: bool = False) -> list[tuple]:
    """Events of many sessions; session ``bot`` has a third of them, at times all in one minute."""
    rng = random.Random(seed)
    rows = []
    for i in range(900):
        key = "bot" if i % 3 == 0 else f"s{rng.randrange(60)}"
        spread = 50 if burst and key == "bot" else 6 * 3600
        at = START + dt.timedelta(seconds=rng.randrange(spread), microseconds=rng.choice([0, 500000]))
        rows.append((f"e{i:04d}", key, "u", rng.choice(["/", "/shop", None]), at, rng.randrange(100)))
    return rows


SCHEMA = "event_id string, session_id string, user_id string, page_url string, timestamp timestamp_ntz, time_on_page_seconds bigint"


def by_session(rows: list[tuple]) -> dict[str, list[tuple]]:
    groups: dict[str, list[tuple]] = {}
    for row in sorted(rows, key=lambda r: (r[1], r[4], r[0])):
        groups.setdefault(row[1], []).append(row)
    return groups


@pytest.mark.parametrize("burst", [False, True])
@pytest.mark.parametrize("chunks", ["1", "8", "40"])
def test_neighbours_do_not_depend_on_the_split(spark, chunks, burst, monkeypatch):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", chunks)
    try:
        check_neighbours(spark, clicks(1, burst))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def check_neighbours(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    found = with_neighbours(
        df, ["session_id"], ["timestamp", "event_id"], previous=["page_url"], following=["timestamp"]
    )
    actual = {r.event_id: (r.step_number, r.prev_page_url, r.next_timestamp) for r in found.collect()}
    expected = {}
    for group in by_session(rows).values():
        for i, row in enumerate(group):
            before = group[i - 1][3] if i else None
            after = group[i + 1][4] if i + 1 < len(group) else None
            expected[row[0]] = (i + 1, before, after)
    assert actual == expected


def test_a_key_at_one_instant_is_cut_into_even_chunks(spark):
    """A third of the rows is one session at one instant, a third has no session."""
    rows = [(f"e{i:05d}", ["bot", None, f"s{i % 50}"][i % 3], "u", "/", START if i % 3 == 0 else START + dt.timedelta(seconds=i), 1) for i in range(6000)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    sizes = [r["count"] for r in in_chunks(df, ["session_id", "timestamp", "event_id"]).groupBy("_chunk").count().collect()]
    assert sum(sizes) == 6000 and max(sizes) <= 2 * 6000 / 8
    found = with_neighbours(df, ["session_id"], ["timestamp", "event_id"], previous=["event_id"], following=["event_id"]).collect()
    assert len(found) == 6000
    assert all(r.step_number == 1 and r.prev_event_id is None and r.next_event_id is None for r in found if r.session_id is None)
    bot = sorted((r.step_number, r.event_id, r.prev_event_id, r.next_event_id) for r in found if r.session_id == "bot")
    names = [f"e{i:05d}" for i in range(0, 6000, 3)]
    assert bot == [(k + 1, n, names[k - 1] if k else None, names[k + 1] if k + 1 < len(names) else None) for k, n in enumerate(names)]


def test_behavior_flow(spark):
    rows = clicks(3)
    found = {r.event_id: r for r in behavior_flow(spark.createDataFrame(rows, SCHEMA)).collect()}
    for group in by_session(rows).values():
        for i, row in enumerate(group):
            gap = int((row[4] - group[i - 1][4]).total_seconds()) if i else 0
            assert (found[row[0]].step_number, found[row[0]].time_since_previous_step_seconds) == (i + 1, gap)


def test_visits_fold_heartbeats(spark):
    rows = clicks(4)
    found = enrich_visits(spark.createDataFrame(rows, SCHEMA)).collect()
    expected = set()
    for key, group in by_session(rows).items():
        starts = [row for i, row in enumerate(group) if i == 0 or row[3] != group[i - 1][3]]
        for i, row in enumerate(starts):
            last = i + 1 == len(starts)
            seconds = row[5] if last else int((starts[i + 1][4] - row[4]).total_seconds())
            expected.add((key, row[0], i + 1, row[3], starts[i - 1][3] if i else None, last, seconds))
    assert {
        (r.session_id, r.event_id, r.visit_number, r.page_url, r.previous_page, r.exit_page, r.time_on_page_seconds)
        for r in found
    } == expected


@pytest.mark.parametrize("gap,seconds", [("1 MINUTE", 60), ("30 MINUTE", 1800), ("2 HOUR", 7200)])
def test_sessions(spark, gap, seconds):
    rows = clicks(5)
    df = spark.createDataFrame(rows, SCHEMA).select(F.col("session_id").alias("user_id"), "timestamp")
    expected = set()
    for key, group in by_session(rows).items():
        times = [row[4] for row in group]
        runs = [[times[0]]]
        for at in times[1:]:
            if (at - runs[-1][-1]).total_seconds() > seconds:
                runs.append([at])
            else:
                runs[-1].append(at)
        expected |= {(key, i + 1, run[0], run[-1], len(run)) for i, run in enumerate(runs)}
    found = sessionise(df, gap).collect()
    assert {(r.user_id, r.session_number, r.session_start_time, r.session_end_time, r.page_views) for r in found} == expected
    assert sum(r.page_views for r in found) == len(rows)


def test_anonymous_visitors_are_told_apart(spark):
    rows = [(None, "a", START), (None, "b", START), (None, "a", START + dt.timedelta(minutes=1)), ("u", "c", START), ("u", "d", START)]
    df = spark.createDataFrame(rows, "user_id string, session_id string, timestamp timestamp_ntz")
    assert sorted((r.user_id or "", r.anonymous_session or "", r.page_views) for r in sessionise(df).collect()) == [("", "a", 2), ("", "b", 1), ("u", "", 2)]


def test_a_pause_of_exactly_the_gap_stays_in_the_session(spark):
    times = [START, START + dt.timedelta(minutes=30), START + dt.timedelta(minutes=60, microseconds=1)]
    df = spark.createDataFrame([("u", t) for t in times], "user_id string, timestamp timestamp_ntz")
    assert sorted(r.page_views for r in sessionise(df).collect()) == [1, 2]


def test_sessions_reject_calendar_gaps(spark):
    with pytest.raises(ValueError):
        sessionise(spark.createDataFrame([], "user_id string, timestamp timestamp_ntz"), "1 MONTH")


def test_status_history_is_null_safe(spark):
    day = lambda d: dt.datetime(2024, 1, d)
    rows = [(1, 1, "pending", day(1)), (1, 2, "pending", day(2)), (1, 3, None, day(3)), (1, 4, None, day(4)),
            (1, 5, "shipped", day(5)), (2, 1, None, day(1)), (2, 2, None, day(2)), (3, 1, "pending", day(1))]
    df = spark.createDataFrame(rows, "order_id int, seq int, order_status string, updated_at timestamp_ntz")
    found = status_history(df).collect()
    assert sorted((r.order_id, r.previous_status or "", r.new_status or "", r.created_at.day) for r in found) == [
        (1, "", "shipped", 5), (1, "pending", "", 3)]


def test_latest_by_key_breaks_ties(spark):
    rows = [(1, START, 1, "a"), (1, START, 2, "b"), (2, START, 1, "c")]
    df = spark.createDataFrame(rows, "k int, updated_at timestamp_ntz, seq int, v string")
    assert sorted(r.v for r in latest_by_key(df, ["k"], ["updated_at", "seq"]).collect()) == ["b", "c"]


def test_conversion_time_needs_a_view_before(spark):
    at = lambda m: START + dt.timedelta(minutes=m)
    rows = [("a", "s1", "view", at(0)), ("b", "s1", "purchase", at(15)), ("c", "s2", "purchase", at(1)),
            ("d", "s3", "purchase", at(1)), ("e", "s3", "view", at(2))]
    df = spark.createDataFrame(rows, "event_id string, session_id string, funnel_step string, purchase_timestamp timestamp_ntz")
    found = {r.event_id: r.conversion_time_seconds for r in conversion_time(df).collect()}
    assert found == {"b": 900, "c": None, "d": None}


def test_growth_rate_from_zero_is_null(spark):
    df = spark.createDataFrame([(1, 0), (2, 10), (3, 15)], "day int, users int")
    assert [r.growth_rate for r in growth_rate(df, "day", "users").orderBy("day").collect()] == [None, None, 50.0]


def test_empty_input(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert behavior_flow(empty).count() == 0
    assert enrich_visits(empty).count() == 0
    assert sessionise(empty).count() == 0
