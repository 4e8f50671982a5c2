"""Catalogue, orders, traffic, funnel, reports and quality on small frames with known answers."""

from __future__ import annotations

import datetime as dt
import json
import random
import re
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from shoplight.operators import catalogue, funnel, games, orders, paging, quality, reports, retention, sequences, service, traffic
from shoplight.sources.shop_views import ShopViews

D = Decimal
GAMES = "game_id int, name string, description string, price decimal(10,2), discount_price decimal(10,2), category string, " \
        "publisher string, tags array<string>, rating decimal(3,2), is_featured boolean, is_trending boolean, stock_quantity int, created_at timestamp_ntz"


@pytest.fixture(scope="module")
def shop(spark):
    day = dt.datetime(2024, 1, 1)
    rows = [
        (1, "Night Rally", "Fast cars after dark", D("59.99"), D("49.99"), "Racing", "North", ["cars", "night"], D("4.50"), True, True, 10, day),
        (2, "Moss Keeper", "A slow forest story", D("19.99"), None, "RPG", "West", ["forest"], D("4.20"), True, False, 0, day),
        (3, "Rally of Kings", None, D("39.99"), D("0.00"), "Strategy", "North", None, D("4.80"), False, True, 5, day),
        (4, "Tide", "Sail the night sea", D("29.99"), None, "RPG", "East", ["sea", "ships"], D("4.20"), False, True, 7, day),
    ]
    return spark.createDataFrame(rows, GAMES)


def ids(df, column="game_id"):
    return [r[column] for r in df.collect()]


def test_filters(shop):
    assert sorted(ids(catalogue.filter_games(shop))) == [1, 2, 3, 4]
    assert ids(catalogue.filter_games(shop, category="rp", min_price="25")) == [4]
    assert ids(catalogue.filter_games(shop, max_price="39.99", trending=True)) == [3, 4]
    assert ids(catalogue.eq_ci(shop, ["category", "publisher"], ".NORTH")) == [1, 3]
    assert sorted(ids(catalogue.eq_ci(shop, ["category"], "*"))) == [1, 2, 3, 4]
    assert ids(catalogue.in_stock(shop, False)) == [2]
    assert ids(catalogue.trending_by_category(shop, ["RPG", "Racing"])) == [1, 4]


def test_search_ranks_names_first(shop):
    assert ids(catalogue.search_games(shop, "rally")) == [3, 1]
    assert ids(catalogue.search_games(shop, "night")) == [1, 4]
    assert ids(catalogue.search_games(shop, "sea night")) == [4]
    assert ids(catalogue.search_games(shop, "sea", limit=0)) == []
    assert ids(catalogue.search_games(shop, "...")) == []
    assert ids(catalogue.search_games(shop, "the rally of")) == [3, 1]
    assert ids(catalogue.search_games(shop, "rallying nights")) == [1] and ids(catalogue.search_games(shop, "rallies")) == [3, 1]
    named = shop.withColumn("name", F.when(F.col("game_id") == 2, "Тёмный Лес").otherwise(F.col("name")))
    assert ids(catalogue.search_games(named, "лес тёмный")) == [2]


def test_substring_search_reads_tags(shop):
    assert sorted(ids(catalogue.search_substring(shop, "SHIP"))) == [4]
    assert sorted(ids(catalogue.search_substring(shop, "night", category="racing"))) == [1]


def test_featured_and_pages(shop):
    assert ids(catalogue.featured(shop)) == [1, 2]
    assert ids(catalogue.featured_by_stock(shop, 2)) == [1, 4]
    page = paging.paginate(shop, paging.sort_keys("rating", "DESC", ("rating",), "name", "game_id"), page=2, limit=2).collect()
    assert [r.game_id for r in page] == [2, 4]
    assert (page[0].total_pages, page[0].total_items, page[0].has_next_page, page[0].has_previous_page) == (2, 4, False, True)
    assert ids(paging.safe_sort(shop, "price; drop", "desc", ("price",), "name", "game_id")) == [4, 3, 1, 2]
    assert paging.paginate(shop, [F.asc("game_id")], page=9).count() == 0


def test_keyset_pages_cover_everything_once(spark):
    rows = [(i, dt.datetime(2024, 1, 1 + i % 5)) for i in range(23)]
    df = spark.createDataFrame(rows, "id int, at timestamp_ntz")
    seen, last = [], None
    while page := paging.page_after(df, "at", "id", last, 4).collect():
        seen += [r.id for r in page]
        last = (page[-1].at, page[-1].id)
    assert seen == [r.id for r in df.orderBy(F.desc("at"), "id").collect()]


@pytest.fixture(scope="module")
def sold(spark):
    rng = random.Random(3)
    reviews = [(i, rng.choice([1, 1, 3]), rng.randrange(4), rng.randrange(1, 6), i % 2 == 0, dt.datetime(2024, 1, 1 + i % 9)) for i in range(40)]
    items = [(i, i % 9, rng.choice([1, 1, 2, 3]), rng.randrange(1, 4), D(rng.randrange(100, 9999)) / 100, dt.datetime(2024, 2, 1)) for i in range(50)]
    return (
        spark.createDataFrame(reviews, "review_id int, game_id int, user_id int, rating int, is_verified_purchase boolean, created_at timestamp_ntz"),
        spark.createDataFrame(items, "id int, order_id int, game_id int, quantity int, total_price decimal(12,2), created_at timestamp_ntz"),
    )


def test_fan_out_equals_the_joined_rows(shop, sold):
    reviews, items = sold
    joined = (
        shop.join(reviews.select("game_id", "review_id", F.col("rating").alias("stars")), "game_id", "left")
        .join(items, "game_id", "left").groupBy("game_id")
        .agg(F.round(F.avg("stars"), 2).alias("a"), F.count("review_id").alias("n"), F.sum("quantity").alias("q"), F.sum("total_price").alias("s"))
    )
    expected = {r.game_id: (r.a, r.n, r.q, r.s) for r in joined.collect()}
    found = catalogue.game_stats(shop, reviews, items).collect()
    assert {r.game_id: (r.average_rating, r.review_count, r.total_sold, r.total_revenue) for r in found} == expected
    once = {r.game_id: r for r in catalogue.game_stats_dedup(shop, reviews, items).collect()}
    for r in found:
        assert once[r.game_id].average_rating == r.average_rating
        assert once[r.game_id].review_count <= r.review_count
        assert (once[r.game_id].total_sold or 0) <= (r.total_sold or 0)


def test_unsold_games_come_last(shop, sold):
    stats = catalogue.game_stats(shop, *sold)
    assert ids(catalogue.top_sellers(stats, 4))[-1] == 4
    trending = catalogue.trending_games(shop, stats).collect()
    assert [r.game_id for r in trending] == [1, 3, 4] and trending[-1].total_sold == 0


def test_game_documents(spark, shop, sold):
    people = spark.createDataFrame([(0, "Ada", "L"), (1, "Bo", "K")], "customer_id int, first_name string, last_name string")
    pages = {r.game_id: r for r in catalogue.game_documents(shop, sold[0], people).collect()}
    assert pages[4].reviews is None and pages[4].review_count == 0
    newest = pages[1].reviews
    assert len(newest) == 5 and [r.position for r in newest] == [1, 2, 3, 4, 5]
    assert [r.created_at for r in newest] == sorted((r.created_at for r in newest), reverse=True)


def test_order_documents_split_large_orders(spark, sold):
    items = sold[1]
    heads = spark.createDataFrame([(i,) for i in range(11)], "order_id int")
    history = spark.createDataFrame(
        [(0, "pending", "shipped", dt.datetime(2024, 2, 1))],
        "order_id int, previous_status string, new_status string, created_at timestamp_ntz",
    )
    for page_rows in (1000, 2):
        found = orders.order_documents(heads, items, history, page_rows).collect()
        got: dict[int, list] = {}
        for r in sorted(found, key=lambda r: (r.order_id, r.page)):
            assert len(r["items"] or []) <= page_rows
            got.setdefault(r.order_id, []).extend(i.id for i in r["items"] or [])
        expected = {k: [] for k in range(11)}
        for r in items.orderBy("created_at", "id").collect():
            expected[r.order_id].append(r.id)
        assert got == expected
        assert sum(len(r.status_history or []) for r in found) == 1


def test_prices(spark):
    lines = [(1, 1, D("25.00"), 2, None), (2, 1, D("25.00"), 2, D("10.00")), (2, 2, D("0.01"), 1, D("0.00")), (3, 1, D("10.03"), 1, None)]
    cart = spark.createDataFrame(lines, "order_id int, game_id int, unit_price decimal(10,2), quantity int, discount_price decimal(10,2)")
    found = {r.order_id: r for r in orders.price_orders(cart, dt.date(2024, 2, 27)).collect()}
    assert (found[1].subtotal, found[1].tax_amount, found[1].shipping_cost, found[1].total_amount) == (D("50.00"), D("4.00"), D("5.99"), D("59.99"))
    assert (found[2].subtotal, found[2].shipping_cost) == (D("50.01"), D("0.00"))
    assert found[3].tax_amount == D("0.80") and found[3].estimated_delivery == dt.date(2024, 3, 3)
    totals = sorted(r.total_price for r in orders.price_lines(cart).collect())
    assert totals == [D("0.01"), D("10.03"), D("20.00"), D("50.00")]
    priced = orders.price_orders(cart, dt.date(2024, 1, 1))
    report = {r.rule: r.violations for r in quality.check_order_totals(priced, orders.price_lines(cart)).collect()}
    assert report == {"total:parts": 0, "total:lines": 1}


def test_cancel(spark):
    df = spark.createDataFrame([(1, "pending"), (2, "shipped"), (3, "delivered"), (4, "confirmed")], "order_id int, order_status string")
    asked = spark.createDataFrame([(1,), (1,), (2,), (3,), (9,)], "order_id int")
    found = {r.order_id: (r.order_status, r.outcome) for r in orders.cancel_orders(df, asked).collect()}
    assert found == {1: ("cancelled", "cancelled"), 2: ("shipped", "rejected"), 3: ("delivered", "rejected"), 9: (None, "not_found")}


def test_customers_without_orders(spark):
    people = spark.createDataFrame([(1, "A", "B", "a@x"), (2, "C", "D", "c@x")], "customer_id int, first_name string, last_name string, email string")
    placed = spark.createDataFrame([(1, D("10.00"), dt.datetime(2024, 1, 1)), (None, D("5.00"), dt.datetime(2024, 1, 2))],
                                   "customer_id int, total_amount decimal(10,2), created_at timestamp_ntz")
    rows = orders.top_customers(orders.customer_order_summary(people, placed)).collect()
    assert [(r.customer_id, r.total_orders, r.total_spent) for r in rows] == [(2, 0, None), (1, 1, D("10.00"))]


def test_cart(spark):
    adds = spark.createDataFrame([("c", 1, None, D("5.00")), ("c", 1, 2, D("5.00")), ("c", 2, 0, D("3.00"))],
                                 "cart_id string, game_id int, quantity int, price decimal(10,2)")
    lines = orders.merge_cart(adds)
    assert sorted((r.game_id, r.quantity) for r in lines.collect()) == [(1, 3), (2, 1)]
    total = orders.cart_totals(lines).first()
    assert (total.unit_count, total.unique_items, total.cart_value) == (4, 2, D("18.00"))


INTERACTIONS = "event_id string, session_id string, user_id string, game_id int, game_title string, game_category string, event_type string, event_data string, timestamp timestamp_ntz"
PURCHASES = "event_id string, session_id string, user_id string, game_id int, total_amount decimal(10,2), purchase_timestamp timestamp_ntz, funnel_step string"


def test_popularity_without_views(spark):
    at = dt.datetime(2024, 1, 1)
    rows = [("1", "s", "u", 1, "A", "x", "purchase", "{}", at), ("2", "s", None, 2, "B", "x", "view", "{}", at), ("3", "t", None, 2, "B", "x", "purchase", "{}", at)]
    found = {r.game_title: r for r in games.game_popularity(spark.createDataFrame(rows, INTERACTIONS)).collect()}
    assert found["A"].conversion_rate is None
    assert (found["B"].conversion_rate, found["B"].unique_sessions) == (100.0, 2)


def test_revenue_products_equal_the_joined_rows(spark):
    rng = random.Random(5)
    at = dt.datetime(2024, 1, 5)
    shown = [(str(i), f"s{rng.randrange(5)}", "u", g, f"T{g % 2}", "c", rng.choice(["view", "purchase"]), "{}", at)
             for i in range(60) for g in [rng.choice([1, 1, 1, 2, 3, 4])]]
    bought = [(str(i), "s", "u", rng.choice([1, 1, 2, 9]), D(rng.randrange(1, 999)) / 100, at, "purchase") for i in range(30)]
    left, right = spark.createDataFrame(shown, INTERACTIONS), spark.createDataFrame(bought, PURCHASES)
    joined = left.join(right.select("game_id", "total_amount"), "game_id", "left").groupBy("game_title").agg(
        F.count("*").alias("n"), F.count_distinct("session_id").alias("s"), F.count_if(F.col("event_type") == "purchase").alias("p"),
        F.coalesce(F.sum("total_amount"), F.lit(0)).alias("r"))
    expected = {r.game_title: (r.n, r.s, r.p, r.r) for r in joined.collect()}
    found = games.game_revenue_join(left, right).collect()
    assert {r.game_title: (r.interactions, r.unique_sessions, r.purchases, r.revenue) for r in found} == expected


def test_ranks_share_ties(spark):
    board = spark.createDataFrame([(1, 10), (2, 10), (3, 7), (4, 5), (5, 5)], "game_id int, views bigint")
    found = {r.game_id: (r.popularity_rank, r.popularity_trend) for r in games.popularity_rank(board).collect()}
    assert found == {1: (1, "trending_up"), 2: (1, "trending_up"), 3: (3, "trending_up"), 4: (4, "stable"), 5: (4, "stable")}


def test_export_reads_json_values(spark):
    at = dt.datetime(2024, 1, 5)
    rows = [("1", "s", "u", 1, "A", "x", "purchase", '{"interaction_value": 12.5}', at), ("2", "s", "u", 1, "A", "x", "purchase", "{}", at),
            ("3", "s", "u", 1, "A", "x", "purchase", "not json", at), ("4", "s", "u", 1, "A", "x", "view", '{"interaction_value": 99}', at)]
    found = {r.interaction_type: r.revenue for r in games.export_interactions(spark.createDataFrame(rows, INTERACTIONS)).collect()}
    assert found == {"purchase": D("12.50"), "view": D("0.00")}


def test_funnel(spark):
    at = dt.datetime(2024, 1, 5)
    steps = ["view"] * 8 + ["add_to_cart"] * 4 + ["purchase"] + ["refund"]
    rows = [(str(i), f"s{i % 3}", "u", 1, D("1.50"), at, s) for i, s in enumerate(steps)]
    rates = funnel.funnel_rates(funnel.conversion_funnel(spark.createDataFrame(rows, PURCHASES)))
    found = {r.funnel_step: (r.step_count, r.conversion_rate, r.drop_off_rate) for r in rates.collect()}
    assert found == {"view": (8, 100.0, 0.0), "add_to_cart": (4, 50.0, 50.0), "purchase": (1, 25.0, 75.0), "refund": (1, 100.0, 0.0)}
    assert sum(v[0] for v in found.values()) == len(rows)
    assert funnel.funnel_revenue(funnel.conversion_funnel(spark.createDataFrame(rows, PURCHASES))).first()[0] == D("21.00")


def test_user_counts(spark):
    day = lambda d: dt.datetime(2024, 1, d)
    rows = [("old", day(1)), ("old", day(20)), ("gone", day(2)), ("new", day(19)), (None, day(19)), (None, day(1))]
    found = traffic.user_counts(spark.createDataFrame(rows, "user_id string, timestamp timestamp_ntz"), "7 DAY", day(20)).first()
    assert (found.total_users, found.active_users, found.new_users, found.returning_users) == (3, 2, 1, 1)


def test_dashboard_adds_minutes_but_exact_does_not(spark):
    at = dt.datetime(2024, 1, 1)
    views = spark.createDataFrame([("s", "u", 5, at), ("s", "u", 7, at + dt.timedelta(minutes=1))],
                                  "session_id string, user_id string, time_on_page_seconds bigint, timestamp timestamp_ntz")
    sessions = spark.createDataFrame([("a", "u", at, 1, 10), ("b", "u", at, 3, 30), ("c", "u", at - dt.timedelta(days=1), 1, 50)],
                                     "session_id string, user_id string, session_start_time timestamp_ntz, page_views bigint, session_duration_seconds bigint")
    minutes, days = traffic.realtime_metrics(views), traffic.user_behavior(sessions)
    loose = traffic.dashboard_summary(minutes, days).first()
    assert (loose.total_page_views, loose.total_sessions, loose.avg_session_duration, loose.bounce_rate) == (2, 2, 35.0, 75.0)
    true = traffic.dashboard_summary_exact(views, sessions).first()
    assert (true.total_page_views, true.total_sessions, true.avg_session_duration, true.bounce_rate) == (2, 1, 30.0, 66.67)
    empty = traffic.dashboard_summary(minutes.limit(0), days.limit(0)).first()
    assert tuple(empty) == (0, 0, 0, 0.0, 0.0)
    probe = traffic.recent_activity_probe(minutes).first()
    assert tuple(probe) == (1, 1, 2)


def test_shares_add_up(spark):
    df = spark.createDataFrame([(k,) for k in "aaabbc"], "k string")
    found = traffic.share_of_total(df, "k").collect()
    assert abs(sum(r.percentage for r in found) - 100) < 0.11
    assert {r.k: r.percentage for r in found} == {"a": 50.0, "b": 33.3, "c": 16.7}


def test_service_map(spark):
    at = dt.datetime(2024, 1, 1)
    rows = [("web", "latency", float(x), at) for x in range(101)] + [("web", "errors", 1.0, at)]
    df = spark.createDataFrame(rows, "service_name string, metric_type string, metric_value double, timestamp timestamp_ntz")
    maps = service.performance_by_service(service.performance_metrics(df, exact=True)).first()
    assert maps.metrics["latency"].p95 == 95.0 and maps.metrics["latency"].samples == 101 and set(maps.metrics) == {"latency", "errors"}


def test_report_needs_name_and_metrics(shop):
    for spec in ({}, {"reportName": "x"}, {"reportName": "x", "metrics": []}, {"metrics": ["sales"]}, {"reportName": "x", "metrics": ["weather"]}):
        with pytest.raises(ValueError):
            reports.build_report(spec, {})


def test_adhoc_sql_is_read_only(spark, shop):
    tables = {"shop_games": shop}
    assert reports.run_report(spark, "SELECT count(*) AS n FROM shop_games WHERE category = :c", tables, {"c": "RPG"}).first().n == 2
    nested = "WITH rpg AS (SELECT * FROM shop_games WHERE category = 'RPG') SELECT (SELECT max(price) FROM rpg) AS p, count(*) AS n FROM shop_games WHERE game_id IN (SELECT game_id FROM rpg)"
    assert reports.run_report(spark, nested, tables).first().n == 2
    refused = (
        "DROP VIEW shop_games", "INSERT INTO shop_games SELECT 1", "CREATE TABLE t AS SELECT 1", "SELECT 1) ; (SELECT 2", "",
        "SELECT 1 a) UNION ALL (SELECT 2", "SELECT * FROM parquet.`/root/testdata/sf0.001/part.parquet`", "SELECT * FROM other",
        "SELECT reflect('java.lang.System', 'getProperty', 'user.home')", "SELECT java_method('java.lang.System', 'getProperty', 'user.home')",
        "SELECT (SELECT count(*) FROM parquet.`/root/testdata/sf0.001/part.parquet`) FROM shop_games",
        "SELECT * FROM shop_games WHERE EXISTS (SELECT 1 FROM other)", "SELECT * FROM range(5)",
        "WITH a AS (SELECT * FROM other) SELECT * FROM a",
    )
    spark.range(1).createOrReplaceTempView("other")
    for text in refused:
        with pytest.raises(Exception):
            reports.run_report(spark, text, tables).collect()
    assert not spark.catalog.tableExists("shop_games") and spark.conf.get("spark.sql.runSQLOnFiles") == "true"


def test_quality_rules(spark, shop):
    df = spark.createDataFrame([(1, None, "a"), (1, 7, "b"), (2, 3, None)], "k int, v int, s string")
    assert {r.rule: r.violations for r in quality.check_not_null(df, ["k", "v", "s"]).collect()} == {"not_null:k": 0, "not_null:v": 1, "not_null:s": 1}
    unique = quality.check_unique(df, ["k"]).first()
    assert (unique.checked_rows, unique.repeated_keys, unique.violations) == (3, 1, 1)
    nulls = spark.createDataFrame([(None, 1), (None, 1), (1, None), (1, None), (2, 2), (2, 2)], "a int, b int")
    assert tuple(quality.check_unique(nulls, ["a", "b"]).first())[1:] == (6, 1, 1)
    assert quality.check_domain(df, {"s": ["a"]}).first().violations == 1
    assert quality.check_range(df, {"v": (1, 5)}).first().violations == 1
    parents = spark.createDataFrame([(3,)], "id int")
    orphan = quality.check_fk(df, parents, "v", "id").first()
    assert (orphan.orphan_keys, orphan.violations) == (1, 1)
    gone = spark.createDataFrame([(1,), (1,)], "k int")
    assert quality.propagate_delete(df, gone, "k").count() == 1
    assert sorted(r.k or 0 for r in quality.propagate_delete(df, gone, "k", "set_null").collect()) == [0, 0, 2]
    with pytest.raises(ValueError):
        quality.propagate_delete(df, gone, "k", "ignore")


def test_retention_at_month_ends(spark):
    rows = [(dt.datetime(2023, 8, 31, 1),), (dt.datetime(2023, 8, 29),), (dt.datetime(2023, 9, 1),)]
    df = spark.createDataFrame(rows, "created_at timestamp_ntz")
    as_of = dt.datetime(2024, 2, 29)
    kept = retention.apply_retention(df, "performance_metrics", as_of)
    assert sorted(r.created_at.day for r in kept.collect()) == [1, 31]
    report = retention.retention_report(df, "performance_metrics", as_of).first()
    assert (report.kept_rows, report.dropped_rows, report.unknown_rows) == (2, 1, 0)
    unknown = df.unionAll(spark.createDataFrame([(None,)], "created_at timestamp_ntz"))
    assert retention.apply_retention(unknown, "performance_metrics", as_of).count() == 3
    assert tuple(retention.retention_report(unknown, "performance_metrics", as_of).first())[1:] == (2, 1, 1)


def test_expiry_removes_folders_and_reads_the_border_day(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = [(i, start + dt.timedelta(hours=i)) for i in range(24 * 20)] + [(-1, None)]
    df = spark.createDataFrame(rows, "id int, created_at timestamp_ntz")
    path, as_of = f"{tmp_path}/dated", dt.datetime(2024, 2, 9, 6, 30)  # 30 days: what is older than the morning of the tenth goes
    retention.write_dated(df, "legacy_performance_metrics", path, "created_at")
    assert retention.expire(spark, path, "legacy_performance_metrics", as_of, "created_at") == (9, 1)
    kept = spark.read.parquet(path)
    want = retention.apply_retention(df, "legacy_performance_metrics", as_of, "created_at")
    assert sorted(r.id for r in kept.collect()) == sorted(r.id for r in want.collect())
    assert sorted(p.name for p in (tmp_path / "dated").glob(f"{retention.DAY}=2024-01-0*")) == []
    assert retention.expire(spark, path, "legacy_performance_metrics", as_of, "created_at") == (0, 1)
    assert spark.read.parquet(path).count() == want.count()
    retention.write_dated(df.filter("id = 3"), "legacy_performance_metrics", path, "created_at")
    assert retention.expire(spark, path, "legacy_performance_metrics", dt.datetime(2030, 1, 1), "created_at")[1] == 0
    assert [r.id for r in spark.read.parquet(path).collect()] == [-1]


def test_any_stored_page_reads_its_ranges_only(spark, tmp_path):
    df = spark.range(5003).select(F.col("id"), (F.col("id") * 7919 % 101).alias("k"), F.lit("x" * 50).alias("text"))
    order = paging.sort_keys("k", "DESC", ["k"], "k", "id")
    paging.write_pages(df, order, f"{tmp_path}/p", 8)
    sizes = {r[paging.RANGE]: r.row_count for r in spark.read.parquet(f"{tmp_path}/p/directory").collect()}
    assert len(sizes) > 4 and sum(sizes.values()) == 5003
    for page in (1, 2, 63, 250, 501):
        found, want = paging.stored_page(spark, f"{tmp_path}/p", order, page, 10), paging.paginate(df, order, page, 10)
        assert [tuple(r) for r in found.collect()] == [tuple(r) for r in want.select(*found.columns).collect()]
        mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
        filters = re.search(r"PartitionFilters: (.*)", found._jdf.queryExecution().explainString(mode))[1]
        held = {int(n) for n in re.findall(r"(?<== )\d+|(?<=[(,])\d+(?=[,)])", filters)}
        assert 1 <= len(held) <= 2 and sum(sizes[n] for n in held) < 5003 / 2
    far = paging.stored_page(spark, f"{tmp_path}/p", order, 900, 10)
    assert far.count() == 0


def test_long_and_short_orders_page_alike(spark):
    items = spark.createDataFrame([(o, i, i % 4) for o, n in ((1, 3), (2, 40), (3, 10), (None, 5)) for i in range(n)], "order_id long, id int, created_at int")
    pages = orders._pages(items, ["created_at", "id"], "rows", 10)
    found = {(r.order_id, r.page): [(e.created_at, e.id) for e in r.rows] for r in pages.collect()}
    every = lambda n: sorted((i % 4, i) for i in range(n))
    assert found == {(1, 0): every(3), (3, 0): every(10), **{(2, p): every(40)[p * 10 : p * 10 + 10] for p in range(4)}}


def test_foreign_keys_take_one_shuffle(spark):
    child = spark.createDataFrame([(1, "a"), (1, "b"), (2, None), (None, "a")], "k int, s string")
    parents, names = spark.createDataFrame([(1,), (3,)], "id bigint"), spark.createDataFrame([("a",), (None,)], "name string")
    report = quality.check_fks([(child, parents, "k", "id"), (child, names, "s", "name"), (names, child, "name", "s")])
    assert [tuple(r) for r in report.collect()] == [("foreign_key:k", 1, 1), ("foreign_key:s", 1, 1), ("foreign_key:name", 0, 0)]
    plan = report._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("hashpartitioning(") == 1 and "Join" not in plan


def test_request_bodies_shuffle_narrow_events(spark, tmp_path):
    rows = [(i, dt.datetime(2024, 1, 1), 1, "view", 1.5, '{"k": 3}') for i in range(120)]
    spark.createDataFrame(rows, "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    bodies = ShopViews(spark, str(tmp_path)).batch_envelopes
    plan = bodies.filter("body_no >= 0")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(") == 1 and plan.index("collect_list(") < plan.index("hashpartitioning(") and "collect_list(" not in plan[plan.index("hashpartitioning("):]
    found = {r.body_no: json.loads(r.body) for r in bodies.collect()}
    assert sorted(found) == [-1, 0, 1, 2] and [len(found[n]["events"]) for n in (0, 1, 2)] == [50, 50, 20]


def test_order_documents_move_each_row_once(spark, monkeypatch):
    at = lambda m: dt.datetime(2024, 1, 1, 0, m)
    heads = spark.createDataFrame([(i, f"o{i}") for i in (0, 1, 2, 3, 3, 5, None)], "order_id int, name string")
    items = spark.createDataFrame([(o, i, at(i % 4)) for o, n in ((1, 5), (2, 9), (3, 2), (7, 9), (None, 9)) for i in range(n)], "order_id int, id int, created_at timestamp_ntz")
    seen = spark.createDataFrame([(o, i, s, at(i)) for o, names in ((1, "aabbc"), (3, "abababab"), (5, "ab"), (None, "ab")) for i, s in enumerate(names)],
                                 "order_id int, seq int, order_status string, updated_at timestamp_ntz")
    documents = lambda: orders.order_documents(heads, items, sequences.status_history(seen), 2)
    shown = lambda df: sorted(str((r.order_id, r.name, r.page, r["items"], r.status_history)) for r in df.collect())
    whole = documents()
    plan = whole._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(") == 3 and plan.count("hashpartitioning(page") == 0 and "page#" not in "".join(re.findall(r"hashpartitioning\(.*", plan))
    found = whole.collect()
    assert {(r.order_id, r.page): [i.id for i in r["items"] or []] for r in found if r.order_id == 2} == {(2, 0): [0, 4], (2, 1): [8, 1], (2, 2): [5, 2], (2, 3): [6, 3], (2, 4): [7]}
    assert sorted((r.order_id or -1, r.page) for r in found) == [(-1, 0), (-1, 0), (1, 0), (1, 1), (1, 2), *[(2, p) for p in range(5)], *[(3, p) for p in (0, 0, 1, 1, 2, 2, 3, 3)], (5, 0)]
    monkeypatch.setattr(sequences, "GROUPED_ROWS", 4)
    assert {r.order_id for r in sequences.long_keys(items, "order_id").collect()} == {1, 2, 7}
    assert shown(documents()) == shown(whole)
