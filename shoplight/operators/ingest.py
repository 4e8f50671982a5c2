"""Event intake: unpack request bodies, normalise events and route them to their tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from shoplight.functions.scalars import content_id, event_time, fitting, given_time, or_default, page_category
from shoplight.functions.times import moment
from shoplight.schemas import ENVELOPE_EVENT, ENVELOPE_TEXTS, SINGLE_EVENT

# Event kinds that have a table.
ROUTES = {
    "page_views": "page_view",
    "game_interactions": "game_interaction",
    "search_events": "search",
    "performance_metrics": "performance",
}
# A visit shorter than this bounces; scroll depth is at most this.
BOUNCE_SECONDS = 10
FULL_SCROLL = 100

_BODY = StructType([StructField("events", ArrayType(ENVELOPE_TEXTS)), *SINGLE_EVENT.fields])


def unpack(raw: DataFrame, body: str = "body") -> DataFrame:
    """The rows of ``raw`` with the texts of one event each (``_event``) and the form of their body (``_form``).

    A body is a ``batch`` if it has events, else a ``single`` event if it has a type, else ``rejected``; the last
    two give one row. Each body is parsed once: the generator keeps Spark from doing it again for later filters.
    The text of a batch is null on its events' rows, so that it is not carried, shuffled and stored once per event.
    """
    parsed = raw.select("*", F.explode(F.array(F.from_json(F.col(body), _BODY))).alias("_body"))
    at = lambda name: F.col("_body")[name]
    either = lambda snake, camel: F.coalesce(F.nullif(at(snake), F.lit("")), F.nullif(at(camel), F.lit("")))
    inner = lambda name: at("metadata")[name]
    outer = {
        "event_type": either("event_type", "eventType"),
        "event_id": either("event_id", "eventId"),
        "session_id": either("session_id", "sessionId"),
        "user_id": either("user_id", "userId"),
        "game_id": F.coalesce(at("game_id"), at("gameId")),
        "timestamp": F.coalesce(at("timestamp"), inner("timestamp")),
        "interaction_type": F.coalesce(inner("interaction_type"), inner("action")),
        "event_data": F.get_json_object(F.col(body), "$.metadata"),
        "clicked_game_id": F.coalesce(at("game_id"), at("gameId")),
    }
    single = F.struct(*[outer.get(f.name, inner(f.name)).alias(f.name) for f in ENVELOPE_TEXTS.fields])
    is_batch = F.coalesce(F.size(at("events")) > 0, F.lit(False))
    form = F.when(is_batch, "batch").when(outer["event_type"].isNotNull(), "single").otherwise("rejected")
    rows = F.when(is_batch, at("events")).otherwise(F.array(single))
    columns = [F.when(form != "batch", F.col(c)).alias(c) if c == body else F.col(c) for c in raw.columns]
    return parsed.select(*columns, form.alias("_form"), rows.alias("_events")).select(
        *raw.columns, "_form", F.explode("_events").alias("_event"))


def typed(unpacked: DataFrame) -> DataFrame:
    """Events in the types of their fields, and ``misfits``: the given values that do not fit, with their fields.

    A missing or empty value fits. ``event_data`` keeps the JSON as it came.
    """
    text = lambda name: F.col("_event")[name]
    columns, wrong = [], []
    for f in ENVELOPE_EVENT.fields:
        value = text(f.name) if isinstance(f.dataType, StringType) else fitting(text(f.name), f.dataType)
        columns.append(value.alias(f.name))
        read = given_time(text("timestamp")) if f.name == "timestamp" else value
        if f.name == "timestamp" or not isinstance(f.dataType, StringType):
            given = (F.length(text(f.name)) > 0) & read.isNull()
            wrong.append(F.when(given, F.struct(F.lit(f.name).alias("field"), text(f.name).alias("value"))))
    return unpacked.select(*columns, F.filter(F.array(*wrong), lambda x: x.isNotNull()).alias("misfits"))


def explode_batch(raw: DataFrame, body: str = "body") -> DataFrame:
    """One row per event of each batch body; bodies without events give none."""
    return typed(unpack(raw, body).filter("_form = 'batch'"))


def rejected_batches(raw: DataFrame, body: str = "body") -> DataFrame:
    """Bodies whose ``events`` is missing, no array, or empty."""
    return unpack(raw, body).filter("_form <> 'batch'").select(*raw.columns)


def normalise_single(raw: DataFrame, body: str = "body") -> DataFrame:
    """Single-event bodies in the row shape of a batch event; bodies without a type are left out.

    Both spellings of the outer names are read; the rest comes from ``metadata``.
    """
    return typed(unpack(raw, body).filter("_form = 'single'"))


def rejected_singles(raw: DataFrame, body: str = "body") -> DataFrame:
    """Bodies without events and without an event type."""
    return unpack(raw, body).filter("_form = 'rejected'").select(*raw.columns)


def ensure_event_id(events: DataFrame) -> DataFrame:
    """Fill a missing event id from the event's content, so a retry or replay gives the same id."""
    given = F.nullif("event_id", F.lit(""))
    content = F.to_json(F.struct(*[c for c in events.columns if c not in ("event_id", "misfits")]))
    return events.withColumn("event_id", F.coalesce(given, content_id(content)))


def _base(received: dt.datetime | Column) -> list[Column]:
    return [
        F.col("event_id"),
        F.col("session_id"),
        F.nullif("user_id", F.lit("")).alias("user_id"),
        event_time(F.col("timestamp"), moment(received)).alias("timestamp"),
        moment(received).cast("timestamp").alias("created_at"),
    ]


def _fits() -> Column:
    return F.size("misfits") == 0


def _of_kind(events: DataFrame, table: str) -> DataFrame:
    return ensure_event_id(events.filter((F.col("event_type") == ROUTES[table]) & _fits()))


def number_or_zero(name: str) -> Column:
    """The number, or 0 where it is missing."""
    return or_default(F.col(name), 0, 0).alias(name)


def flag_or_false(name: str) -> Column:
    """The flag, or false where it is missing."""
    return F.coalesce(name, F.lit(False)).alias(name)


def text_or(name: str, default: str | None = None) -> Column:
    """The text, or ``default`` where it is missing or empty."""
    return or_default(F.col(name), "", F.lit(default).cast("string")).alias(name)


def route_page_views(events: DataFrame, received: dt.datetime | Column) -> DataFrame:
    """Rows of the page view table."""
    return _of_kind(events, "page_views").select(
        *_base(received), "page_url", "page_title", "page_category",
        number_or_zero("time_on_page_seconds"), number_or_zero("scroll_depth_percentage"),
        flag_or_false("exit_page"), flag_or_false("bounce"), text_or("previous_page"), text_or("referrer", ""),
    )


def route_game_interactions(events: DataFrame, received: dt.datetime | Column) -> DataFrame:
    """Rows of the game interaction table; the interaction type becomes the event type."""
    data = F.coalesce(F.nullif("event_data", F.lit("")), F.lit("{}"))
    return _of_kind(events, "game_interactions").select(
        *_base(received), "game_id", "game_title", "game_category",
        F.col("interaction_type").alias("event_type"), data.alias("event_data"), text_or("page_context", ""),
    )


def route_searches(events: DataFrame, received: dt.datetime | Column) -> DataFrame:
    """Rows of the search table; a clicked position or game of 0 means none."""
    return _of_kind(events, "search_events").select(
        *_base(received), "search_query", text_or("search_category"), number_or_zero("results_count"),
        F.nullif("clicked_result_position", F.lit(0)).alias("clicked_result_position"),
        F.nullif("clicked_game_id", F.lit(0)).alias("clicked_game_id"), flag_or_false("no_results"),
    )


def route_performance(events: DataFrame, received: dt.datetime | Column) -> DataFrame:
    """Rows of the performance table; the event id becomes the metric id."""
    rows = _of_kind(events, "performance_metrics").select(
        *_base(received), "service_name", "metric_type", "metric_value", text_or("unit", ""), text_or("endpoint"),
        F.nullif("status_code", F.lit(0)).alias("status_code"), text_or("error_message"),
    )
    return rows.drop("session_id", "user_id").withColumnRenamed("event_id", "metric_id")


def route_unknown(events: DataFrame) -> DataFrame:
    """Events of a kind that has no table, or of none, and events with a value that does not fit; ``misfits`` names those."""
    known = F.coalesce(F.col("event_type").isin(*ROUTES.values()), F.lit(False))
    return ensure_event_id(events.filter(~(known & _fits())))


ROUTERS = {
    "page_views": route_page_views,
    "game_interactions": route_game_interactions,
    "search_events": route_searches,
    "performance_metrics": route_performance,
}


def ingest_receipt(events: DataFrame) -> DataFrame:
    """Events in total, per table and in quarantine, and how many of those for a value that does not fit; in one pass."""
    per_table = [F.count_if((F.col("event_type") == kind) & _fits()).alias(table) for table, kind in ROUTES.items()]
    known = F.coalesce(F.col("event_type").isin(*ROUTES.values()), F.lit(False))
    return events.agg(F.count("*").alias("total"), *per_table, F.count_if(~(known & _fits())).alias("quarantined"),
                      F.count_if(~_fits()).alias("misfits"))


def derive_flags(page_views: DataFrame) -> DataFrame:
    """Client-side derivations: category from the path, bounce under ten seconds, referrer, capped scroll depth."""
    return page_views.withColumns({
        "page_category": page_category(F.col("page_url")),
        "bounce": F.col("time_on_page_seconds") < BOUNCE_SECONDS,
        "referrer": text_or("referrer", "direct"),
        "scroll_depth_percentage": F.least(F.lit(FULL_SCROLL), F.round("scroll_depth_percentage").cast("int")),
    })


def derive_no_results(searches: DataFrame) -> DataFrame:
    """A search without results is flagged."""
    return searches.withColumn("no_results", F.col("results_count") == 0)
