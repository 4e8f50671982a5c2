"""The shop's logical tables, derived from the generic order, line, part and event tables.

Each property builds a DataFrame that reads only the columns its query asks for. The rules
are the test-data mapping described in ``FIXTURES.md``.
"""

from __future__ import annotations

import datetime as dt
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shoplight.functions.scalars import page_category
from shoplight.functions.times import seconds_between
from shoplight.schemas import PAYMENT_METHODS, RAW_TABLES


# Services that the test data stand for.
SERVICES = ("frontend", "game-service", "order-service", "analytics-service")


def pick(index: Column, *values: str) -> Column:
    """The value at ``index`` modulo the number of values."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(index, F.lit(len(values))) + 1).cast("int"))


class ShopViews:
    """Logical tables over one data folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root

    def base(self, name: str) -> DataFrame:
        return self.spark.read.schema(RAW_TABLES[name]).parquet(f"{self.root}/{name}.parquet")

    def newest_event(self) -> Column:
        """The time that stands for "now": the newest event, found when the query runs."""
        return self.base("events").agg(F.max("ts")).scalar()

    def newest_event_value(self) -> dt.datetime:
        """The same as a value, for names of folders. One value reaches the driver."""
        return self.base("events").agg(F.max("ts")).first()[0]

    # ---- events -----------------------------------------------------------------------

    @cached_property
    def ev(self) -> DataFrame:
        user = F.col("user_id").cast("string")
        return self.base("events").select(
            F.col("event_id").cast("string").alias("event_id"),
            F.col("event_id").alias("event_no"),
            F.concat_ws("-", user, F.to_date("ts").cast("string")).alias("session_id"),
            user.alias("user_id"),
            F.col("user_id").alias("user_no"),
            F.col("ts").alias("timestamp"),
            F.col("event_type").alias("kind"),
            "value",
            "props",
            F.get_json_object("props", "$.k").cast("int").alias("k"),
        )

    @cached_property
    def some_anonymous(self) -> DataFrame:
        """The events, every seventh of them by a visitor who is no user."""
        return self.ev.withColumn("user_id", F.when(F.col("event_no") % 7 != 0, F.col("user_id")))

    @cached_property
    def _game_events(self) -> DataFrame:
        part = self.base("part").select("p_partkey", "p_name", "p_type")
        step = F.when(F.col("kind") == "click", "add_to_cart").when(F.col("kind") == "signup", "checkout")
        return self.ev.join(part, F.col("k") == F.col("p_partkey")).select(
            *self.ev.columns,
            F.col("p_partkey").alias("game_id"),
            F.col("p_name").alias("game_title"),
            F.col("p_type").alias("game_category"),
            step.otherwise(F.col("kind")).alias("event_type"),
        )

    @cached_property
    def game_interactions(self) -> DataFrame:
        return self._game_events.select(
            "event_id", "session_id", "user_id", "game_id", "game_title", "game_category", "event_type",
            F.col("props").alias("event_data"), "timestamp", F.lit("product_page").alias("page_context"),
        )

    @cached_property
    def purchase_events(self) -> DataFrame:
        amount = F.col("value").cast("decimal(10,2)")
        return self._game_events.filter(F.col("kind") != "error").select(
            "event_id", "session_id", "user_id",
            F.concat(F.lit("order_"), "event_id").alias("order_id"),
            F.col("user_id").alias("customer_id"),
            "game_id", "game_title", "game_category",
            F.lit(1).alias("quantity"),
            amount.alias("unit_price"),
            F.lit(0).cast("decimal(10,2)").alias("discount_amount"),
            amount.alias("total_amount"),
            pick(F.col("k"), *PAYMENT_METHODS).alias("payment_method"),
            F.col("timestamp").alias("purchase_timestamp"),
            F.col("event_type").alias("funnel_step"),
            F.when(F.col("k") % 10 == 0, "pending").otherwise("completed").alias("status"),
        )

    @cached_property
    def page_views(self) -> DataFrame:
        url = pick(F.col("k"), "/", "/shop.html", "/product-details.html", "/contact.html", "/faq.html")
        seconds = F.floor("value")
        return self.ev.filter(F.col("kind").isin("view", "click")).select(
            "event_id", "session_id", "user_id",
            url.alias("page_url"),
            page_category(url).alias("page_category"),
            "timestamp",
            seconds.alias("time_on_page_seconds"),
            F.least(F.lit(100), F.col("k")).alias("scroll_depth_percentage"),
            (seconds < 10).alias("bounce"),
            F.when(F.col("k") % 4 == 0, F.lit(None)).otherwise(F.lit("search")).alias("referrer"),
        )

    @cached_property
    def search_events(self) -> DataFrame:
        clicked = F.col("k") % 3 == 0
        return self._game_events.filter(F.col("kind") == "view").select(
            "event_id", "session_id", "user_id",
            F.col("game_title").alias("search_query"),
            F.col("game_category").alias("search_category"),
            F.col("k").alias("results_count"),
            F.when(clicked, F.col("k") % 10 + 1).alias("clicked_result_position"),
            F.when(clicked, F.col("game_id")).alias("clicked_game_id"),
            (F.col("k") == 0).alias("no_results"),
            "timestamp",
        )

    @cached_property
    def performance_metrics(self) -> DataFrame:
        return self.ev.select(
            F.col("event_id").alias("metric_id"),
            pick(F.col("user_no"), *SERVICES).alias("service_name"),
            F.col("kind").alias("metric_type"),
            F.col("value").alias("metric_value"),
            F.lit("ms").alias("unit"),
            "timestamp",
        )

    @cached_property
    def user_sessions(self) -> DataFrame:
        nation = self.base("nation").select("n_nationkey", F.col("n_name").alias("country"))
        sessions = self.ev.groupBy("session_id", "user_id", "user_no").agg(
            F.min("timestamp").alias("session_start_time"),
            F.max("timestamp").alias("session_end_time"),
            F.count("*").alias("page_views"),
        )
        return sessions.join(nation, F.pmod("user_no", F.lit(25)) == F.col("n_nationkey"), "left").select(
            "session_id", "user_id",
            pick(F.col("user_no"), "desktop", "mobile", "tablet").alias("device_type"),
            pick(F.col("user_no"), "Chrome", "Safari", "Firefox", "Edge").alias("browser"),
            "country", "session_start_time", "session_end_time", "page_views",
            seconds_between(F.col("session_start_time"), F.col("session_end_time")).alias("session_duration_seconds"),
        )

    # ---- raw envelopes ----------------------------------------------------------------

    @cached_property
    def envelope_events(self) -> DataFrame:
        """Events in the field names a client sends, with gaps where a client may leave them."""
        return self._envelopes(self.ev, "event_no")

    def _envelopes(self, ev: DataFrame, *kept: str) -> DataFrame:
        k = F.col("k")
        return ev.select(
            *kept,
            pick_kind().alias("event_type"),
            F.when(k % 13 != 0, F.col("event_id")).alias("event_id"),
            "session_id",
            F.when(k % 17 != 0, F.col("user_id")).otherwise("").alias("user_id"),
            F.when(k % 11 != 0, F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")).alias("timestamp"),
            pick(k, "/", "/shop.html", "/product-details.html", "/contact.html", "/faq.html").alias("page_url"),
            F.when(k % 7 != 0, F.floor("value")).alias("time_on_page_seconds"),
            (k + 20).alias("scroll_depth_percentage"),
            F.when(k % 6 != 0, F.lit("search")).alias("referrer"),
            k.cast("bigint").alias("game_id"),
            F.when(k % 3 == 0, "view").otherwise("purchase").alias("interaction_type"),
            F.when(k % 5 != 0, F.struct(F.col("value").cast("string").alias("interaction_value"))).alias("event_data"),
            F.concat(F.lit("game "), k).alias("search_query"),
            (k % 10).cast("bigint").alias("results_count"),
            (k % 4).alias("clicked_result_position"),
            pick(F.col("user_no"), *SERVICES).alias("service_name"),
            F.lit("response_time").alias("metric_type"),
            F.col("value").alias("metric_value"),
            F.when(k % 2 == 0, 200).otherwise(0).alias("status_code"),
        )

    @cached_property
    def batch_envelopes(self) -> DataFrame:
        """Raw request bodies of fifty events each, and one empty body per five hundred events.

        The narrow events are brought together, not the wide envelopes that are made of them.
        """
        together = self.ev.withColumn("body_no", F.floor(F.col("event_no") / 50)).repartition("body_no")
        envelopes = self._envelopes(together, "body_no")
        event = F.struct(*[c for c in envelopes.columns if c != "body_no"])
        full = (
            envelopes.groupBy("body_no")
            .agg(F.collect_list(event).alias("events"))
            .select("body_no", F.to_json(F.struct("events")).alias("body"))
        )
        empty = self.ev.filter(F.col("event_no") % 500 == 0).select(
            (-F.col("event_no") - 1).alias("body_no"),
            F.when(F.col("event_no") % 1000 == 0, '{"events": []}').otherwise('{"other": 1}').alias("body"),
        )
        return full.unionByName(empty)

    @cached_property
    def single_envelopes(self) -> DataFrame:
        """One camelCase body per event; every k that ends in 9 comes without an event type."""
        body = F.to_json(
            F.struct(
                F.when(F.col("k") % 10 != 9, pick_kind()).alias("eventType"),
                F.col("user_id").alias("userId"),
                F.col("k").cast("bigint").alias("gameId"),
                F.col("session_id").alias("sessionId"),
                F.create_map(
                    F.lit("page_url"), pick(F.col("k"), "/", "/shop.html", "/product-details.html"),
                    F.lit("time_on_page_seconds"), F.floor("value").cast("string"),
                    F.lit("action"), F.lit("view"),
                    F.lit("search_query"), F.concat(F.lit("game "), "k"),
                    F.lit("metric_value"), F.col("value").cast("string"),
                    F.lit("timestamp"), F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"),
                ).alias("metadata"),
            )
        )
        return self.ev.select("event_no", body.alias("body"))

    # ---- catalogue and orders -----------------------------------------------------------

    @cached_property
    def games(self) -> DataFrame:
        key = F.col("p_partkey")
        price = F.col("p_retailprice").cast("decimal(10,2)")
        return self.base("part").select(
            key.alias("game_id"),
            F.col("p_name").alias("name"),
            F.concat_ws(" ", F.lit("A"), F.lower("p_type"), F.lit("title by"), "p_brand").alias("description"),
            price.alias("price"),
            F.when(key % 3 == 0, (price * F.lit("0.8").cast("decimal(2,1)")).cast("decimal(10,2)")).alias("discount_price"),
            F.col("p_type").alias("category"),
            F.split("p_name", " ").alias("tags"),
            ((F.lit(10) + F.col("p_size") % 41) / 10).cast("decimal(3,2)").alias("rating"),
            (key % 5 == 0).alias("is_featured"),
            (key % 7 == 0).alias("is_trending"),
            F.when(key % 9 == 0, 0).otherwise(F.col("p_size")).alias("stock_quantity"),
            F.col("p_brand").alias("publisher"),
            F.date_add(F.lit(dt.date(2020, 1, 1)), (key % 1000).cast("int")).alias("release_date"),
            F.date_add(F.lit(dt.date(2023, 1, 1)), (key % 300).cast("int")).cast("timestamp_ntz").alias("created_at"),
        )

    @cached_property
    def order_items(self) -> DataFrame:
        price = F.col("l_extendedprice").cast("decimal(12,2)")
        discount = F.col("l_discount").cast("decimal(4,2)")
        return self.base("lineitem").select(
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
            F.col("l_orderkey").alias("order_id"),
            F.col("l_partkey").alias("game_id"),
            F.col("l_linenumber").alias("line_number"),
            F.col("l_quantity").cast("int").alias("quantity"),
            price.alias("unit_price"),
            F.when(F.col("l_discount") > 0, (price * (F.lit(1).cast("decimal(4,2)") - discount)).cast("decimal(12,2)")).alias("discount_price"),
            (price * (F.lit(1).cast("decimal(4,2)") - discount)).cast("decimal(12,2)").alias("total_price"),
            F.col("l_shipdate").alias("created_at"),
        )

    @cached_property
    def orders(self) -> DataFrame:
        key = F.col("o_orderkey")
        status = F.col("o_orderstatus")
        total = F.col("o_totalprice").cast("decimal(12,2)")
        return self.base("orders").select(
            key.alias("order_id"),
            F.col("o_custkey").alias("customer_id"),
            F.when(status == "P", "pending").when(status == "O", "shipped").otherwise("delivered").alias("order_status"),
            total.alias("total_amount"),
            pick(key, *PAYMENT_METHODS).alias("payment_method"),
            pick(key, "paid", "pending", "refunded").alias("payment_status"),
            F.when(key % 10 != 0, F.col("o_custkey") * 2).alias("shipping_address_id"),
            (F.col("o_custkey") * 2 + 1).alias("billing_address_id"),
            F.col("o_orderdate").alias("created_at"),
        )

    @cached_property
    def customers(self) -> DataFrame:
        return self.base("customer").select(
            F.col("c_custkey").alias("customer_id"),
            F.col("c_name").alias("first_name"),
            F.col("c_mktsegment").alias("last_name"),
            F.concat(F.lower("c_name"), F.lit("@example.com")).alias("email"),
            F.concat(F.lit("+"), F.col("c_nationkey").cast("string")).alias("phone"),
        )

    @cached_property
    def customer_addresses(self) -> DataFrame:
        nation = self.base("nation").join(
            self.base("region"), F.col("n_regionkey") == F.col("r_regionkey"), "left"
        ).select("n_nationkey", F.col("n_name").alias("city"), F.col("r_name").alias("country"))
        kinds = F.explode(F.array(F.lit("shipping"), F.lit("billing")))
        people = self.base("customer").select("c_custkey", "c_name", "c_nationkey", kinds.alias("address_type"))
        billing = (F.col("address_type") == "billing").cast("bigint")
        return people.join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left").select(
            (F.col("c_custkey") * 2 + billing).alias("address_id"),
            F.col("c_custkey").alias("customer_id"),
            "address_type",
            F.concat(F.col("c_name"), F.lit(" street "), F.col("address_type")).alias("address_line_1"),
            "city", "country",
        )

    @cached_property
    def game_reviews(self) -> DataFrame:
        buyers = self.base("orders").select("o_orderkey", "o_custkey")
        return (
            self.base("lineitem").filter(F.col("l_returnflag") == "R")
            .join(buyers, F.col("l_orderkey") == F.col("o_orderkey"))
            .select(
                (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("review_id"),
                F.col("l_partkey").alias("game_id"),
                F.col("o_custkey").alias("user_id"),
                (F.lit(1) + F.col("l_linenumber") % 5).alias("rating"),
                (F.col("l_linestatus") == "F").alias("is_verified_purchase"),
                F.col("l_shipdate").alias("created_at"),
            )
        )

    @cached_property
    def status_snapshots(self) -> DataFrame:
        """Order states over time; a state may be seen more than once."""
        ships = self.base("lineitem").groupBy("l_orderkey").agg(
            F.min("l_shipdate").alias("first_ship"), F.max("l_shipdate").alias("last_ship")
        )
        orders = self.base("orders").join(ships, F.col("o_orderkey") == F.col("l_orderkey"), "left")
        hour = F.make_dt_interval(F.lit(0), F.lit(1))
        seen = lambda no, status, at: F.struct(
            F.lit(no).alias("seq"), F.lit(status).alias("order_status"), at.alias("updated_at")
        )
        done = F.when(F.col("o_orderstatus") == "F", F.col("last_ship"))
        states = F.explode(F.array(
            seen(1, "pending", F.col("o_orderdate")), seen(2, "pending", F.col("o_orderdate") + hour),
            seen(3, "shipped", F.col("first_ship")), seen(4, "shipped", F.col("first_ship") + hour),
            seen(5, "delivered", done),
        ))
        return (
            orders.select(F.col("o_orderkey").alias("order_id"), states.alias("s"))
            .filter(F.col("s.updated_at").isNotNull())
            .select("order_id", "s.seq", "s.order_status", "s.updated_at")
        )


def pick_kind() -> Column:
    """The client's name for an event kind; a purchase has no target table."""
    kind = F.col("kind")
    return (
        F.when(kind == "view", "page_view").when(kind == "click", "game_interaction")
        .when(kind == "signup", "search").when(kind == "error", "performance").otherwise(kind)
    )
