"""Scalar rules of the event model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, IntegerType, LongType

# Funnel steps in their order.
FUNNEL_STEPS = ("view", "add_to_cart", "checkout", "purchase")

# Home page paths, then path parts and their page category, in order of precedence.
HOME_PATHS = ("/", "/index.html")
PATH_CATEGORIES = {"shop": "shop", "product-details": "product", "contact": "contact"}


def percent(part: Column, whole: Column) -> Column:
    """Share in percent with two decimals; NULL where the whole is zero."""
    return F.round(F.try_divide(part, whole) * 100, 2)


def distinct_count(column: str, approx: bool = False) -> Column:
    """Distinct non-null values: exact, or one mergeable sketch per group."""
    return F.approx_count_distinct(column) if approx else F.count_distinct(column)


def or_default(column: Column, zero, default) -> Column:
    """The column, or ``default`` where it is NULL or the empty value of its type."""
    return F.coalesce(F.nullif(column, F.lit(zero)), default if isinstance(default, Column) else F.lit(default))


def funnel_position(step: Column) -> Column:
    """1 to 4 for the known funnel steps, 5 for any other label."""
    known = F.array_position(F.array(*[F.lit(label) for label in FUNNEL_STEPS]), step)
    return F.coalesce(F.nullif(known, F.lit(0)), F.lit(len(FUNNEL_STEPS) + 1)).cast("int")


def page_category(path: Column) -> Column:
    """Category of a page path; the first matching rule wins."""
    category = F.when(path.isin(*HOME_PATHS), "homepage")
    for part, label in PATH_CATEGORIES.items():
        category = category.when(path.contains(part), label)
    return category.otherwise("other")


def content_id(*columns: Column) -> Column:
    """An id made from the row's content, so that a retried task gives the same id."""
    return F.sha2(F.concat_ws("|", *columns), 256)


def given_time(text: Column) -> Column:
    """The instant of an ISO-8601 text or of a number of milliseconds since 1970; NULL where it is neither."""
    number = text.rlike("^-?[0-9]{9,15}$")
    return F.when(number, F.timestamp_millis(text.try_cast("bigint"))).otherwise(F.try_to_timestamp(text))


def event_time(text: Column, default: Column) -> Column:
    """UTC time, cut to the second, of a given time; ``default`` where there is none."""
    return F.date_trunc("SECOND", F.coalesce(given_time(text), default.cast("timestamp")))


def fitting(text: Column, kind: DataType) -> Column:
    """The value of a text in a type, NULL where it does not fit; a whole number may be written with a fraction of zero."""
    if isinstance(kind, (IntegerType, LongType)):
        number = text.try_cast("double")
        whole = F.when((number == F.floor(number)) & (F.abs(number) < 2**53), number.try_cast(kind))
        return F.coalesce(text.try_cast(kind), whole)
    return text.try_cast(kind)
