"""Streams against their batch results: restarts, replays, late and unordered rows, empty input."""

from __future__ import annotations

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from shoplight.operators.sequences import sessionise, status_history
from shoplight.operators.traffic import traffic_by, user_counts
from shoplight.streaming import intake, sessions, status, summaries
from shoplight.streaming.tables import compact, read_states, read_table

START = dt.datetime(2024, 1, 1)
VIEWS = "session_id string, user_id string, time_on_page_seconds bigint, timestamp timestamp"


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def page_views(spark, n=400, seed=1):
    rng = random.Random(seed)
    rows = [(f"s{rng.randrange(30)}" if i % 3 else "bot", f"u{rng.randrange(9)}", rng.randrange(200),
             (START + dt.timedelta(seconds=rng.randrange(4 * 3600))).isoformat(sep=" ")) for i in range(n)]
    return spark.createDataFrame(rows, "session_id string, user_id string, time_on_page_seconds bigint, timestamp string").withColumn(
        "timestamp", F.col("timestamp").cast("timestamp"))


def arrive(df, path):
    df.coalesce(1).write.mode("append").parquet(path)


def source(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def halves(df, k=2):
    return [df.filter(F.pmod(F.hash(*df.columns), F.lit(k)) == i) for i in range(k)]


def test_traffic_equals_batch_after_restart_with_unordered_rows(spark, tmp_path):
    views = page_views(spark)
    for part in halves(views):
        arrive(part, f"{tmp_path}/in")
        stream = source(spark, f"{tmp_path}/in", views.schema)
        summaries.stream_traffic(stream, f"{tmp_path}/out", f"{tmp_path}/ck", "hour").awaitTermination()
    found = summaries.finish_traffic(read_table(spark, f"{tmp_path}/out"), "hour")
    expected = traffic_by(views, "hour", "hour")
    assert rows_of(found) == rows_of(expected.select(*found.columns))


def test_a_replayed_batch_counts_once(spark, tmp_path):
    views = page_views(spark)
    for _ in range(2):
        summaries.write_batch(summaries.traffic_states(views, "hour"), f"{tmp_path}/out", 0)
    assert read_table(spark, f"{tmp_path}/out").agg(F.sum("views")).first()[0] == 400


def test_windows_lose_no_late_row(spark, tmp_path):
    at = lambda minute: (f"s{minute}", "u", 1, START + dt.timedelta(minutes=minute))
    batches = [[at(0), at(60)], [at(55)], [at(1), at(-3 * 1440)]]  # an hour and three days late
    for rows in batches:
        arrive(spark.createDataFrame(rows, VIEWS), f"{tmp_path}/in")
        stream = source(spark, f"{tmp_path}/in", spark.createDataFrame([], VIEWS).schema)
        summaries.stream_realtime(stream, f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
    states = read_table(spark, f"{tmp_path}/out")
    minutes = {(r.window_start - START) // dt.timedelta(minutes=1): r.page_views for r in summaries.finish_windows(states).collect()}
    assert minutes == {0: 1, 1: 1, 55: 1, 60: 1, -4320: 1}
    hours = {(r.window_start - START) // dt.timedelta(minutes=1): r.unique_sessions
             for r in summaries.finish_windows(states, "1 hour", "30 minutes").collect()}
    assert hours == {-30: 2, 0: 3, 30: 2, 60: 1, -4320: 1, -4350: 1}


def test_hourly_sales_update_old_hours(spark, tmp_path):
    schema = "game_id bigint, total_amount decimal(10,2), status string, purchase_timestamp timestamp"
    sale = lambda m, a, s="completed": (1, a, s, START + dt.timedelta(minutes=m))
    from decimal import Decimal as D

    batches = [[sale(0, D("1.00")), sale(5, D("9.00"), "pending")], [sale(10, D("2.50")), sale(61, D("4.00"))], [sale(-1440, D("3.00"))]]
    for rows in batches:
        arrive(spark.createDataFrame(rows, schema), f"{tmp_path}/in")
        stream = source(spark, f"{tmp_path}/in", spark.createDataFrame([], schema).schema)
        summaries.stream_hourly_sales(stream, f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
    found = summaries.finish_sales(read_table(spark, f"{tmp_path}/out"))
    everything = spark.createDataFrame(sum(batches, []), schema)
    assert rows_of(found) == rows_of(summaries.hourly_sales(everything))
    assert sorted(r.total_orders for r in found.collect()) == [1, 1, 2]


def test_sketches_merge_over_batches(spark, tmp_path):
    views = page_views(spark, 900).select("user_id", "timestamp", F.lit(1).alias("game_id"), F.lit("view").alias("event_type"))
    for part in halves(views):
        arrive(part, f"{tmp_path}/in")
        stream = source(spark, f"{tmp_path}/in", views.schema)
        summaries.stream_dau(stream, f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 2
    assert rows_of(summaries.finish_dau(spark, f"{tmp_path}/out")) == rows_of(summaries.dau_exact(views))


def test_sessions_equal_batch_over_unordered_batches(spark, tmp_path):
    views = page_views(spark, 500, seed=4).select(
        F.when(F.col("session_id") != "s1", F.col("session_id")).alias("user_id"), F.concat(F.lit("c"), "user_id").alias("session_id"), "timestamp")
    for part in halves(views, 5):
        arrive(part, f"{tmp_path}/in")
        stream = source(spark, f"{tmp_path}/in", views.schema)
        sessions.stream_sessions(stream, f"{tmp_path}/out", f"{tmp_path}/ck", "5 MINUTE").awaitTermination()
    found = sessions.finish_sessions(read_table(spark, f"{tmp_path}/out"), "5 MINUTE").na.fill("-")
    expected = sessionise(views, "5 MINUTE").na.fill("-")
    assert found.count() > 50 and rows_of(found) == rows_of(expected.select(*found.columns))


def test_closed_late_and_open_sessions_are_all(spark, tmp_path):
    rng = random.Random(8)
    rows = [(f"u{rng.randrange(6)}" if i % 4 else None, f"c{rng.randrange(4)}", START + dt.timedelta(minutes=i + rng.randrange(30))) for i in range(600)]
    rows += [("u1", "c", START + dt.timedelta(minutes=k * 30)) for k in range(5)]  # pauses of just the gap
    rows.sort(key=lambda r: r[2])
    early, schema = rows[5:9], "user_id string, session_id string, timestamp timestamp"
    batches = [rows[:5] + rows[9:200], rows[200:400], rows[400:500] + early, rows[500:]]
    path = f"{tmp_path}/s"
    for batch in batches:
        arrive(spark.createDataFrame(batch, schema), f"{tmp_path}/in")
        sessions.stream_arrivals(source(spark, f"{tmp_path}/in", spark.createDataFrame([], schema).schema), path, f"{tmp_path}/ck1", "40 MINUTE").awaitTermination()
        sessions.close_sessions(spark, path, f"{tmp_path}/ck2", "30 MINUTE", "40 MINUTE").awaitTermination()
    late = spark.read.parquet(f"{path}/late")
    assert sorted(r.timestamp for r in late.collect()) == sorted(r[2] for r in early)
    closed, still_open = spark.read.parquet(f"{path}/closed").drop("batch_id"), sessions.open_sessions(spark, path)
    on_time = spark.createDataFrame([r for b in batches for r in b if r not in early], schema)
    want = sessionise(on_time).select(*closed.columns).na.fill("-")
    assert closed.count() > 10 and still_open.count() > 0
    assert rows_of(closed.unionByName(still_open).na.fill("-")) == rows_of(want)
    counted = sum(r.page_views for r in closed.collect()) + sum(r.page_views for r in still_open.collect())
    assert counted + late.count() == len(rows)


@pytest.fixture()
def snapshots(spark):
    rng = random.Random(9)
    rows = []
    for i in range(300):
        rows.append((1 if i % 3 == 0 else rng.randrange(2, 20), i, rng.choice(["pending", "shipped", None]), START + dt.timedelta(minutes=i)))
    return spark.createDataFrame(rows, "order_id bigint, seq int, order_status string, updated_at timestamp")


def changes_of(df):
    return sorted((r.order_id, str(r.previous_status), str(r.new_status), r.created_at) for r in df.collect())


def test_status_changes_equal_batch_over_restarts(spark, tmp_path, snapshots):
    before = spark.conf.get(status.PROVIDER, None)
    for k in range(4):  # every batch is a run of its own, and the kept statuses are those of Spark's state store
        arrive(snapshots.filter((F.col("seq") >= k * 75) & (F.col("seq") < (k + 1) * 75)), f"{tmp_path}/in")
        stream = source(spark, f"{tmp_path}/in", snapshots.schema)
        status.stream_status_history(stream, f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
    assert changes_of(read_table(spark, f"{tmp_path}/out/history")) == changes_of(status_history(snapshots))
    assert [p.name for p in (tmp_path / "out").iterdir()] == ["history"] and (tmp_path / "ck" / "state").is_dir()
    assert spark.conf.get(status.PROVIDER, None) == before


def test_a_status_batch_that_runs_again_gives_the_same_rows(spark, tmp_path, snapshots):
    for k in range(2):
        arrive(snapshots.filter(F.col("seq") % 2 == 0 if k == 0 else F.col("seq") % 2 == 1).filter("seq < 80"), f"{tmp_path}/in")
        stream = source(spark, f"{tmp_path}/in", snapshots.schema)
        status.stream_status_history(stream, f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
    once = changes_of(read_table(spark, f"{tmp_path}/out/history"))
    (tmp_path / "ck" / "commits" / "1").unlink()  # as if the driver had died after the batch was written
    (tmp_path / "ck" / "commits" / ".1.crc").unlink(missing_ok=True)
    stream = source(spark, f"{tmp_path}/in", snapshots.schema)
    status.stream_status_history(stream, f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
    assert changes_of(read_table(spark, f"{tmp_path}/out/history")) == once


def test_status_of_odd_snapshots(spark, tmp_path):
    at = lambda m: START + dt.timedelta(minutes=m)
    rows = [(1, 1, None, at(0)), (1, 2, None, at(1)), (1, 3, "paid", at(2)), (1, 3, "paid", at(2)), (2, 2, "b", at(5)), (2, 1, "a", at(5)),
            (None, 1, "lost", at(0)), (None, 2, "gone", at(1)), (3, None, "x", None), (3, 1, "y", at(0))]
    arrive(spark.createDataFrame(rows, "order_id bigint, seq int, order_status string, updated_at timestamp"), f"{tmp_path}/in")
    stream = source(spark, f"{tmp_path}/in", spark.read.parquet(f"{tmp_path}/in").schema)
    status.stream_status_history(stream, f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
    assert changes_of(read_table(spark, f"{tmp_path}/out/history")) == [(1, "None", "paid", at(2)), (2, "a", "b", at(5)), (3, "x", "y", at(0))]


def test_status_state_is_kept_by_pages(spark, tmp_path):
    ids = [-257, -256, -1, 0, 1, 255, 256, 600]
    schema = "order_id bigint, seq int, order_status string, updated_at timestamp"
    for seq, current in enumerate(["a", "b", None]):
        arrive(spark.createDataFrame([(i, seq, current, START + dt.timedelta(minutes=seq)) for i in ids], schema), f"{tmp_path}/in")
        stream = source(spark, f"{tmp_path}/in", spark.read.parquet(f"{tmp_path}/in").schema)
        status.stream_status_history(stream, f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
    want = [(i, *c) for i in ids for c in (("a", "b", START + dt.timedelta(minutes=1)), ("b", "None", START + dt.timedelta(minutes=2)))]
    assert changes_of(read_table(spark, f"{tmp_path}/out/history")) == want
    pages = spark.read.format("statestore").option("stateVarName", "last_statuses").load(f"{tmp_path}/ck").select("key.page", "value.orders").collect()
    assert sorted((r.page, sorted(r.orders)) for r in pages) == [(-2, [-257]), (-1, [-256, -1]), (0, [0, 1, 255]), (1, [256]), (2, [600])]


def plain_windows(rows, long, step):
    found = {}
    for session, user, seconds, at in rows:
        minute = int((at - dt.datetime(1970, 1, 1)).total_seconds() // 60)
        for begin in range((minute - long) // step * step + step, minute // step * step + 1, step):
            found.setdefault(begin, []).append((session, user, seconds))
    return sorted((dt.datetime(1970, 1, 1) + dt.timedelta(minutes=b), len(v), len({s for s, _, _ in v if s}), len({u for _, u, _ in v if u}))
                  for b, v in found.items())


@pytest.mark.parametrize("length, slide, long, step", [("60 minutes", "1 minute", 60, 1), ("1 hour", "15 minutes", 60, 15), ("50 minutes", "20 minutes", 50, 20)])
def test_sliding_windows_against_every_window(spark, length, slide, long, step):
    rng = random.Random(long + step)
    rows = [(rng.choice(["a", "b", "hot", "hot", "hot", None]), rng.choice(["u", "v", None]), rng.choice([3, None]),
             START + dt.timedelta(minutes=rng.choice([rng.randrange(40), rng.randrange(3000), -4000]), seconds=rng.randrange(60))) for _ in range(300)]
    states = [summaries.traffic_states(spark.createDataFrame(rows[i::3], VIEWS), "minute") for i in range(3)]
    windows = summaries.finish_windows(states[0].unionByName(states[1]).unionByName(states[2]), length, slide)
    found = sorted((r.window_start, r.page_views, r.unique_sessions, r.unique_users) for r in windows.collect())
    assert found == plain_windows(rows, long, step)
    assert summaries.finish_windows(states[0].limit(0), length, slide).count() == 0


def test_a_sweep_makes_two_rows_of_a_state_at_most(spark):
    rows = [(f"s{i}", f"u{i}", 1, START + dt.timedelta(minutes=i % 7)) for i in range(500)]
    states = summaries.traffic_states(spark.createDataFrame(rows, VIEWS), "minute")
    timed = states.withColumn("_minute", F.floor(F.unix_seconds(F.col("bucket").cast("timestamp")) / 60).cast("bigint"))
    turns = summaries._comings_and_goings(timed, "session_id", F.col("_minute") - 59, F.col("_minute"), 1)
    assert turns.select(F.sum(F.abs("turn"))).head()[0] <= 2 * states.count()


def test_user_counts_read_the_period_s_dates_only(spark, tmp_path):
    rng = random.Random(5)
    rows = [(f"u{rng.randrange(60)}" if i % 5 else None, START + dt.timedelta(hours=rng.randrange(24 * 20))) for i in range(400)]
    events = spark.createDataFrame(rows, "user_id string, timestamp timestamp")
    for k in range(3):  # unordered batches
        summaries.write_batch(summaries.first_seen(events.filter(F.pmod(F.hash("timestamp"), F.lit(3)) == k)), f"{tmp_path}/first", k, ["event_date"])
    before = read_states(spark, f"{tmp_path}/first").count()
    compact(spark, f"{tmp_path}/first", summaries.merge_first_seen, dt.date(2024, 1, 10))
    events.withColumn("event_date", F.to_date("timestamp")).write.partitionBy("event_date").parquet(f"{tmp_path}/events")
    stored_events, as_of = spark.read.parquet(f"{tmp_path}/events"), START + dt.timedelta(days=19, hours=5)
    found = summaries.user_counts(stored_events, read_states(spark, f"{tmp_path}/first"), "2 DAY", as_of)
    assert rows_of(found) == rows_of(user_counts(spark.read.parquet(f"{tmp_path}/events"), "2 DAY", as_of).select(*found.columns))
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    scans = found._jdf.queryExecution().explainString(mode)
    assert any("isnotnull(event_date" in line and ">= 2024-01-18" in line for line in scans.splitlines() if line.startswith("PartitionFilters"))
    assert before > read_states(spark, f"{tmp_path}/first").count()


def test_percentiles_from_states_of_unordered_batches(spark, tmp_path):
    rng = random.Random(3)
    rows = [("api" if i % 3 else "db", rng.choice(["latency", "cpu"]), rng.lognormvariate(3, 1) if i % 50 else None,
             START + dt.timedelta(seconds=rng.randrange(3 * 3600))) for i in range(30_000)]
    samples = spark.createDataFrame(rows, "service_name string, metric_type string, metric_value double, timestamp timestamp")
    for part in halves(samples, 6):
        arrive(part, f"{tmp_path}/in")
    stream = source(spark, f"{tmp_path}/in", samples.schema)
    summaries.stream_performance(stream, f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
    states = read_states(spark, f"{tmp_path}/out")
    for unit in ("hour", None):
        for r in summaries.finish_performance(states, unit).collect():
            values = sorted(v for s, m, v, at in rows if v is not None and (s, m) == (r.service_name, r.metric_type)
                            and (unit is None or at.replace(minute=0, second=0) == r.period_start))
            assert r.sample_count == len(values) and (r.min_value, r.max_value) == (values[0], values[-1])
            assert abs(sum(v <= r.p95_value for v in values) / len(values) - 0.95) < 0.01
            assert r.avg_value == pytest.approx(sum(values) / len(values))
    merged = summaries.merge_performance(states)
    assert merged.count() < states.count() and merged.agg(F.sum("samples")).head()[0] == states.agg(F.sum("samples")).head()[0]


def test_intake_routes_both_body_forms_and_survives_a_restart(spark, tmp_path):
    batch = {"events": [{"event_type": t, "event_id": f"{t}{i}", "session_id": "s"} for i, t in enumerate(
        ["page_view", "page_view", "game_interaction", "search", "performance", "purchase"])]}
    single = {"eventType": "page_view", "userId": "u", "sessionId": "t", "metadata": {"page_url": "/"}}
    both = {"eventType": "search", "sessionId": "t", "events": [], "metadata": {"search_query": "cars"}}
    first = [json.dumps(batch), json.dumps(single), json.dumps(both), "rubbish", '{"events": []}']
    second = [json.dumps({"events": [{"event_type": "search", "event_id": "z", "session_id": "s"}]})]
    (tmp_path / "in").mkdir()
    for i, bodies in enumerate((first, second)):
        (tmp_path / "in" / f"{i}.txt").write_text("\n".join(bodies))
        stream = intake.read_bodies(spark, f"{tmp_path}/in")
        intake.stream_ingest(stream, f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
    count = lambda t: read_table(spark, f"{tmp_path}/out/{t}").count()
    assert {t: count(t) for t in ("page_views", "game_interactions", "search_events", "performance_metrics", "quarantine", "rejected")} == {
        "page_views": 3, "game_interactions": 1, "search_events": 3, "performance_metrics": 1, "quarantine": 1, "rejected": 2}
    receipts = read_table(spark, f"{tmp_path}/out/receipts").agg(F.sum("total"), F.count("*")).first()
    assert tuple(receipts) == (9, 2)


def test_a_half_written_intake_batch_is_not_shown_and_keeps_its_time(spark, tmp_path, monkeypatch):
    bodies = lambda n: json.dumps({"events": [{"event_type": "page_view", "event_id": f"{n}-{i}", "session_id": "s"} for i in range(n)]})
    (tmp_path / "in").mkdir()
    out, checkpoint = f"{tmp_path}/out", f"{tmp_path}/ck"

    def run():
        intake.stream_ingest(intake.read_bodies(spark, f"{tmp_path}/in"), out, checkpoint).awaitTermination()

    (tmp_path / "in" / "0.txt").write_text(bodies(3))
    run()
    (tmp_path / "in" / "1.txt").write_text(bodies(4))
    whole = intake.write_batch

    def broken(df, path, batch_id, *rest):
        if path.endswith("rejected"):
            raise OSError("disk full")
        whole(df, path, batch_id, *rest)

    monkeypatch.setattr(intake, "write_batch", broken)
    with pytest.raises(Exception):
        run()
    monkeypatch.setattr(intake, "write_batch", whole)
    views = lambda: intake.read_received(spark, out, "page_views")
    assert views().count() == 3
    noted = intake.first_note(spark, f"{checkpoint}-received/1", "later")
    assert noted != "later"
    run()
    assert views().count() == 7
    assert {r.created_at.isoformat() for r in views().filter("event_id LIKE '4-%'").collect()} == {noted}


def test_streams_over_empty_input(spark, tmp_path):
    empty = spark.createDataFrame([], VIEWS)
    empty.write.parquet(f"{tmp_path}/in")
    stream = source(spark, f"{tmp_path}/in", empty.schema)
    summaries.stream_traffic(stream, f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
    sessions.stream_sessions(stream.select("user_id", "timestamp"), f"{tmp_path}/s", f"{tmp_path}/ck2").awaitTermination()


def test_files_of_a_day_stay_level_and_compaction_loses_nothing(spark, tmp_path):
    path, files = f"{tmp_path}/states", {}
    rows = []
    for batch in range(61):
        day = START + dt.timedelta(days=batch // 20)
        new = [(f"s{batch % 7}", "u", 5, day), ("late", "v", 1, START)]
        rows += new
        states = summaries.traffic_states(spark.createDataFrame(new, VIEWS), "hour").withColumn("event_date", F.to_date("bucket"))
        summaries.write_batch(states.coalesce(1), path, batch, ["event_date"])
        if batch % 10 == 9:
            compact(spark, path, summaries.merge_traffic, dt.date(2024, 1, 10))
        if batch in (20, 40, 60):
            files[batch] = sum("event_date=2024-01-01" in f for f in read_states(spark, path).inputFiles())
            found = summaries.finish_traffic(read_states(spark, path), "hour")
            expected = traffic_by(spark.createDataFrame(rows, VIEWS), "hour", "hour")
            assert rows_of(found) == rows_of(expected.select(*found.columns))
    assert max(files.values()) <= files[20] + 1


def test_compaction_keeps_rows_without_a_date_and_closed_dates(spark, tmp_path):
    path = f"{tmp_path}/states"
    days = [None, dt.date(2024, 1, 1), dt.date(2024, 1, 5), dt.date(2024, 1, 9)]
    for batch in range(3):
        summaries.write_batch(spark.createDataFrame([(batch, d) for d in days], "n int, event_date date"), path, batch, ["event_date"])
    every = sorted((n, str(d)) for n in range(3) for d in days)
    found = lambda: sorted((r.n, str(r.event_date)) for r in read_states(spark, path).collect())
    compact(spark, path, lambda df: df, dt.date(2024, 1, 8))
    assert found() == every
    with pytest.raises(ValueError):
        compact(spark, path, lambda df: df, dt.date(2024, 1, 3))
    assert found() == every
    compact(spark, path, lambda df: df, dt.date(2024, 1, 10))
    assert found() == every
