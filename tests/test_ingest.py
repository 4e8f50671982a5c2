"""Request bodies: unpacking, defaults, routing, rejects."""

from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from shoplight.operators import ingest

NOW = dt.datetime(2025, 1, 20, 9, 30, 15, 400000)
EVENTS = [
    {"event_type": "page_view", "event_id": "p1", "session_id": "s1", "user_id": "u1", "timestamp": "2025-01-15T10:00:00.123Z",
     "page_url": "/shop", "time_on_page_seconds": 42, "bounce": True},
    {"event_type": "page_view", "session_id": "s1", "user_id": "", "page_url": "/", "time_on_page_seconds": 0, "referrer": ""},
    {"event_type": "game_interaction", "event_id": "g1", "session_id": "s1", "game_id": 7, "interaction_type": "add_to_cart",
     "event_data": {"quantity": 2}, "timestamp": "2025-01-15 10:00:05"},
    {"event_type": "game_interaction", "event_id": "", "session_id": "s1", "game_id": 7, "interaction_type": "view"},
    {"event_type": "search", "event_id": "q1", "session_id": "s2", "search_query": "cars", "clicked_result_position": 0, "clicked_game_id": 0, "search_category": ""},
    {"event_type": "search", "event_id": "q2", "session_id": "s2", "search_query": "cars", "results_count": 3, "clicked_result_position": 1, "no_results": False},
    {"event_type": "performance", "event_id": "m1", "session_id": "x", "service_name": "web", "metric_type": "latency", "metric_value": 12.5, "status_code": 0},
    {"event_type": "purchase", "event_id": "b1", "session_id": "s1"},
    {"event_id": "n1", "session_id": "s1"},
]


@pytest.fixture(scope="module")
def events(spark):
    bodies = [json.dumps({"events": EVENTS[:5]}), json.dumps({"events": EVENTS[5:]})]
    return ingest.explode_batch(spark.createDataFrame([(b,) for b in bodies], "body string"))


def test_rejected_bodies(spark):
    bodies = ['{"events": []}', "{}", "not json", '{"events": null}', '{"events": "x"}', json.dumps({"events": EVENTS})]
    raw = spark.createDataFrame([(b,) for b in bodies], "body string")
    assert ingest.rejected_batches(raw).count() == 5
    assert ingest.explode_batch(raw).count() == len(EVENTS)


def test_page_views(events):
    first, second = ingest.route_page_views(events, NOW).orderBy(F.desc("page_url")).collect()
    assert (first.event_id, first.user_id, first.time_on_page_seconds, first.bounce, first.exit_page) == ("p1", "u1", 42, True, False)
    assert (first.referrer, first.previous_page, first.scroll_depth_percentage) == ("", None, 0)
    assert str(first.timestamp.replace(tzinfo=None)).startswith("2025-01-15 10:00:00")
    assert second.user_id is None and len(second.event_id) == 64
    assert second.timestamp.replace(tzinfo=None) == NOW.replace(microsecond=0)


def test_interactions_carry_json(events):
    found = {r.event_type: r for r in ingest.route_game_interactions(events, NOW).collect()}
    assert json.loads(found["add_to_cart"].event_data) == {"quantity": 2}
    assert found["view"].event_data == "{}" and len(found["view"].event_id) == 64 and found["view"].page_context == ""


def test_searches_have_no_position_zero(events):
    found = {r.event_id: r for r in ingest.route_searches(events, NOW).collect()}
    assert (found["q1"].clicked_result_position, found["q1"].clicked_game_id, found["q1"].search_category, found["q1"].results_count) == (None, None, None, 0)
    assert (found["q2"].clicked_result_position, found["q2"].results_count, found["q2"].no_results) == (1, 3, False)


def test_performance_has_a_metric_id(events):
    row = ingest.route_performance(events, NOW).first()
    assert (row.metric_id, row.metric_value, row.status_code, row.unit, row.endpoint) == ("m1", 12.5, None, "", None)


def test_unknown_kinds_are_kept_and_the_receipt_adds_up(events):
    assert sorted(r.event_id for r in ingest.route_unknown(events).collect()) == ["b1", "n1"]
    receipt = ingest.ingest_receipt(events).first().asDict()
    assert receipt.pop("misfits") == 0
    assert receipt.pop("total") == sum(receipt.values()) == len(EVENTS)
    assert receipt["quarantined"] == 2


def test_made_ids_are_stable_and_differ(events):
    once, twice = ({r.event_id for r in ingest.ensure_event_id(df).collect()} for df in (events, events.repartition(5)))
    assert once == twice and len(once) == len(EVENTS)


def test_single_bodies(spark):
    bodies = [
        {"eventType": "page_view", "userId": "u", "sessionId": "s", "metadata": {"page_url": "/", "time_on_page_seconds": 9, "bounce": True, "timestamp": "2025-01-15T10:00:00Z"}},
        {"event_type": "search", "user_id": "u", "session_id": "s", "gameId": 4, "metadata": {"search_query": "cars", "results_count": "many"}},
        {"eventType": "", "userId": "u"}, {"userId": "u"},
    ]
    raw = spark.createDataFrame([(json.dumps(b),) for b in bodies] + [("oops",)], "body string")
    found = {r.event_type: r for r in ingest.normalise_single(raw).collect()}
    assert set(found) == {"page_view", "search"}
    view, search = found["page_view"], found["search"]
    assert (view.session_id, view.page_url, view.time_on_page_seconds, view.bounce) == ("s", "/", 9, True)
    assert view.timestamp == "2025-01-15T10:00:00Z"
    assert (search.clicked_game_id, search.search_query, search.results_count) == (4, "cars", None)
    assert [tuple(m) for m in search.misfits] == [("results_count", "many")] and view.misfits == []
    assert json.loads(view.event_data) == bodies[0]["metadata"]
    assert ingest.rejected_singles(raw).count() == 3


def test_values_fit_or_are_reported(spark):
    given = [("a", {"time_on_page_seconds": 12.7}), ("b", {"time_on_page_seconds": "abc"}), ("c", {"time_on_page_seconds": "12", "game_id": "7"}),
             ("d", {"timestamp": "garbage"}), ("e", {"timestamp": 1736935200123}), ("f", {"time_on_page_seconds": 5.0, "bounce": "true"}),
             ("g", {"time_on_page_seconds": "", "timestamp": ""}), ("h", {"bounce": "perhaps", "scroll_depth_percentage": "1e9999"})]
    body = json.dumps({"events": [{"event_type": "page_view", "event_id": i, **fields} for i, fields in given]})
    events = ingest.explode_batch(spark.createDataFrame([(body,)], "body string"))
    kept = {r.event_id: r for r in ingest.route_page_views(events, NOW).collect()}
    assert set(kept) == {"c", "e", "f", "g"}
    assert (kept["c"].time_on_page_seconds, kept["f"].time_on_page_seconds, kept["f"].bounce, kept["g"].time_on_page_seconds) == (12, 5, True, 0)
    assert str(kept["e"].timestamp.replace(tzinfo=None)).startswith("2025-01-15 10:00:00")
    found = {r.event_id: sorted(tuple(m) for m in r.misfits) for r in ingest.route_unknown(events).collect()}
    assert found == {"a": [("time_on_page_seconds", "12.7")], "b": [("time_on_page_seconds", "abc")], "d": [("timestamp", "garbage")],
                     "h": [("bounce", "perhaps"), ("scroll_depth_percentage", "1e9999")]}
    receipt = ingest.ingest_receipt(events).first()
    assert (receipt.total, receipt.page_views, receipt.quarantined, receipt.misfits) == (8, 4, 4, 4)


def test_flags(spark):
    views = spark.createDataFrame([("/shop.html", 9, None, 120.4), ("/", 10, "", 33.5)], "page_url string, time_on_page_seconds int, referrer string, scroll_depth_percentage double")
    found = ingest.derive_flags(views).collect()
    assert [(r.page_category, r.bounce, r.referrer, r.scroll_depth_percentage) for r in found] == [
        ("shop", True, "direct", 100), ("homepage", False, "direct", 34)]
    searches = spark.createDataFrame([(0,), (2,)], "results_count int")
    assert [r.no_results for r in ingest.derive_no_results(searches).collect()] == [True, False]


def test_a_batch_text_is_not_carried_by_its_events(spark):
    bodies = ['{"events": [{"event_type": "search"}, {"event_type": "error"}]}', '{"eventType": "search"}', '{"other": 1}', None]
    rows = ingest.unpack(spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "n int, body string")).select("n", "body", "_form", "_event.event_type")
    assert sorted(tuple(r) for r in rows.collect() if r.n) == [(1, bodies[1], "single", "search"), (2, bodies[2], "rejected", None), (3, None, "rejected", None)]
    assert sorted(tuple(r) for r in rows.collect() if not r.n) == [(0, None, "batch", "error"), (0, None, "batch", "search")]
