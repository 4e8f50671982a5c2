"""Orders, customers and carts."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoplight.functions.times import moment
from shoplight.operators.sequences import long_keys, with_neighbours
from shoplight.session import stored

# Tax rate, flat shipping cost, the subtotal above which shipping is free, delivery days.
TAX_RATE = "0.08"
SHIPPING_COST = "5.99"
FREE_SHIPPING_ABOVE = 50
DELIVERY_DAYS = 5
MONEY = "decimal(18,2)"


def mean(column: str) -> Column:
    """Mean of a decimal column as a double."""
    return F.try_divide(F.sum(column).cast("double"), F.count(column))


def rounded_mean(column: str) -> Column:
    """Mean of a decimal column rounded to cents, in decimal arithmetic throughout."""
    return F.round(F.try_divide(F.sum(column), F.count(column).cast("decimal(20,0)")), 2).cast(MONEY)


def filter_orders(orders: DataFrame, status: str | None = None, customer_id=None) -> DataFrame:
    """Orders in a status, of a customer, or both."""
    if status:
        orders = orders.filter(F.col("order_status") == status)
    if customer_id is not None:
        orders = orders.filter(F.col("customer_id") == customer_id)
    return orders


def orders_by_status(orders: DataFrame, status: str) -> DataFrame:
    """Orders in a status, whatever the case, with their count on each row."""
    found = orders.filter(F.lower("order_status") == status.lower())
    return found.select("*", found.agg(F.count("*")).scalar().alias("status_count"))


def cancel_orders(orders: DataFrame, ids: DataFrame) -> DataFrame:
    """The outcome of cancelling each requested order: shipped and delivered ones are refused."""
    known = orders.select("order_id", "order_status")
    final = F.col("order_status").isin("shipped", "delivered")
    outcome = F.when(F.col("order_status").isNull(), "not_found").when(final, "rejected").otherwise("cancelled")
    status = F.when(outcome == "cancelled", "cancelled").otherwise(F.col("order_status"))
    return ids.select("order_id").distinct().join(known, "order_id", "left").select(
        "order_id", F.col("order_status").alias("previous_status"), status.alias("order_status"), outcome.alias("outcome")
    )


def orders_with_customer(orders: DataFrame, customers: DataFrame) -> DataFrame:
    """Orders with the customer's name and contact; orders without a customer are kept."""
    people = customers.select("customer_id", "first_name", "last_name", "email", "phone")
    return orders.join(people, "customer_id", "left")


def _address(addresses: DataFrame, role: str, order_column: str, fields: Sequence[str]) -> DataFrame:
    return addresses.select(F.col("address_id").alias(order_column), *[F.col(c).alias(f"{role}_{c}") for c in fields])


def order_full_detail(orders: DataFrame, customers: DataFrame, addresses: DataFrame) -> DataFrame:
    """Orders with customer, shipping address and billing address."""
    fields = ("address_line_1", "city", "country")
    return (
        orders_with_customer(orders, customers)
        .join(_address(addresses, "ship", "shipping_address_id", fields), "shipping_address_id", "left")
        .join(_address(addresses, "bill", "billing_address_id", fields), "billing_address_id", "left")
    )


def order_details(orders: DataFrame, customers: DataFrame, addresses: DataFrame) -> DataFrame:
    """Orders of known customers with the shipping address."""
    people = customers.select("customer_id", "first_name", "last_name", "email")
    ship = _address(addresses, "ship", "shipping_address_id", ("address_line_1", "city", "country"))
    return orders.join(people, "customer_id").join(ship, "shipping_address_id", "left").select(
        "order_id", "order_status", "total_amount", "payment_method", "payment_status",
        F.col("created_at").alias("order_date"),
        "customer_id", "first_name", "last_name", "email",
        F.col("ship_address_line_1").alias("shipping_address"),
        F.col("ship_city").alias("shipping_city"),
        F.col("ship_country").alias("shipping_country"),
    )


def customer_order_summary(customers: DataFrame, orders: DataFrame) -> DataFrame:
    """Orders, spend, mean order and last order per customer; customers without orders are kept."""
    placed = orders.groupBy("customer_id").agg(
        F.count("*").alias("_orders"),
        F.sum("total_amount").alias("total_spent"),
        mean("total_amount").alias("average_order_value"),
        F.max("created_at").alias("last_order_date"),
    )
    return customers.join(placed, "customer_id", "left").select(
        "customer_id", "first_name", "last_name", "email",
        F.coalesce("_orders", F.lit(0)).alias("total_orders"),
        "total_spent", "average_order_value", "last_order_date",
    )


def top_customers(summary: DataFrame) -> DataFrame:
    """Customers by spend; those without orders come first, as in a descending sort with NULLs first."""
    return summary.orderBy(F.desc_nulls_first("total_spent"), "customer_id")


def customer_stats(orders: DataFrame) -> DataFrame:
    """Orders, spend and mean order value per customer, rounded."""
    return orders.groupBy("customer_id").agg(
        F.count("*").alias("total_orders"),
        F.sum("total_amount").alias("total_spent"),
        rounded_mean("total_amount").alias("average_order_value"),
    )


def monthly_sales(orders: DataFrame) -> DataFrame:
    """Orders, revenue and mean order value per month, newest first."""
    return orders.groupBy(F.to_date(F.date_trunc("month", "created_at")).alias("month")).agg(
        F.count("*").alias("orders_count"),
        F.sum("total_amount").alias("total_revenue"),
        mean("total_amount").alias("average_order_value"),
    ).orderBy(F.desc("month"))


def daily_orders(orders: DataFrame, days: int | None = None, as_of: dt.datetime | None = None) -> DataFrame:
    """Orders and revenue per day, newest first: all of them, or since midnight ``days`` days before ``as_of``, by default the newest order."""
    if days is not None:
        newest = orders.agg(F.max("created_at")).scalar() if as_of is None else moment(as_of)
        orders = orders.filter(F.col("created_at") >= F.date_trunc("day", newest) - F.make_dt_interval(F.lit(days)))
    return orders.groupBy(F.to_date("created_at").alias("order_date")).agg(
        F.count("*").alias("orders_count"), F.sum("total_amount").alias("daily_revenue")
    ).orderBy(F.desc("order_date"))


def order_summary(orders: DataFrame) -> DataFrame:
    """Order headline in one row. ``completed`` is no order status, so that count stays 0."""
    with_status = lambda s: F.count_if(F.col("order_status") == s)
    return orders.agg(
        F.count("*").alias("total_orders"),
        with_status("pending").alias("pending_orders"),
        with_status("completed").alias("completed_orders"),
        with_status("shipped").alias("shipped_orders"),
        with_status("delivered").alias("delivered_orders"),
        rounded_mean("total_amount").alias("average_order_value"),
        F.sum("total_amount").alias("total_revenue"),
        F.count_distinct("customer_id").alias("unique_customers"),
    )


def status_breakdown(orders: DataFrame) -> DataFrame:
    """Orders per status."""
    return orders.groupBy("order_status").agg(F.count("*").alias("order_count"))


def revenue_summary(orders: DataFrame) -> DataFrame:
    """Order count, revenue and mean order value."""
    return orders.agg(
        F.count("*").alias("total_orders"),
        F.sum("total_amount").alias("total_revenue"),
        rounded_mean("total_amount").alias("average_order_value"),
    )


def sales_by_category(items: DataFrame, games: DataFrame) -> DataFrame:
    """Units and revenue per category; lines are added up per game before the catalogue is joined."""
    per_game = items.groupBy("game_id").agg(F.sum("quantity").alias("_units"), F.sum("total_price").alias("_revenue"))
    return per_game.join(games.select("game_id", "category"), "game_id").groupBy("category").agg(
        F.sum("_units").alias("sales"), F.sum("_revenue").alias("revenue")
    ).orderBy(F.desc("revenue"), "category")


def sales_headline(orders: DataFrame, interactions: DataFrame) -> DataFrame:
    """Revenue, orders and mean order value beside the shop-wide conversion rate."""
    of_type = lambda t: F.count_if(F.col("event_type") == t)
    rate = interactions.agg(F.round(F.try_divide(of_type("purchase"), of_type("view")) * 100, 2)).scalar()
    return revenue_summary(orders).withColumn("conversion_rate", rate)


def customer_orders(orders: DataFrame, customer_id) -> DataFrame:
    """One customer's orders; page them with ``paginate`` newest first."""
    return filter_orders(orders, customer_id=customer_id).select(
        "order_id", "order_status", "total_amount", "payment_method", "payment_status", "created_at"
    )


def price_lines(cart_lines: DataFrame) -> DataFrame:
    """Line totals: the discount price where there is one, else the unit price, times quantity."""
    price = F.coalesce(F.nullif("discount_price", F.lit(0)), F.col("unit_price"))
    return cart_lines.withColumn("total_price", (price * F.col("quantity").cast("decimal(10,0)")).cast(MONEY))


def price_orders(cart_lines: DataFrame, as_of: dt.date) -> DataFrame:
    """Orders priced from their lines: subtotal, tax, shipping, total and delivery date.

    The subtotal uses the unit price; discounts show in the line totals only.
    """
    amount = (F.col("unit_price") * F.col("quantity").cast("decimal(10,0)")).cast(MONEY)
    subtotal = cart_lines.groupBy("order_id").agg(F.sum(amount).cast(MONEY).alias("subtotal"))
    tax = F.round(F.col("subtotal") * F.lit(TAX_RATE).cast("decimal(3,2)"), 2).cast(MONEY)
    shipping = F.when(F.col("subtotal") > FREE_SHIPPING_ABOVE, F.lit("0")).otherwise(F.lit(SHIPPING_COST)).cast(MONEY)
    return subtotal.select(
        "order_id", F.lit("pending").alias("order_status"), "subtotal",
        tax.alias("tax_amount"), shipping.alias("shipping_cost"),
        (F.col("subtotal") + tax + shipping).cast(MONEY).alias("total_amount"),
        F.date_add(F.lit(as_of), DELIVERY_DAYS).alias("estimated_delivery"),
    )


def merge_cart(adds: DataFrame) -> DataFrame:
    """One line per cart and game; a missing quantity counts as one, and what is in no cart gives no line."""
    quantity = F.coalesce(F.nullif("quantity", F.lit(0)), F.lit(1))
    return adds.filter(F.col("cart_id").isNotNull()).groupBy("cart_id", "game_id").agg(F.sum(quantity).alias("quantity"), F.max("price").alias("price"))


def cart_totals(lines: DataFrame) -> DataFrame:
    """Units, distinct games and value per cart."""
    return lines.groupBy("cart_id").agg(
        F.sum("quantity").alias("unit_count"), F.count("*").alias("unique_items"),
        F.sum(F.col("price") * F.col("quantity")).alias("cart_value"),
    )


def game_library(items: DataFrame, orders: DataFrame) -> DataFrame:
    """Each user's games with the time of the first purchase; orders without a buyer belong to no library."""
    buyers = orders.filter(F.col("customer_id").isNotNull()).select("order_id", F.col("customer_id").alias("user_id"), F.col("created_at").alias("bought_at"))
    return items.select("order_id", "game_id").join(buyers, "order_id").groupBy("user_id", "game_id").agg(
        F.min("bought_at").alias("purchased_at")
    )


def _total(rows: DataFrame, order: Sequence[str]) -> list[str]:
    """``order`` with the other columns behind it, which break ties."""
    return [*order, *[c for c in rows.columns if c not in ("order_id", *order)]]


def _pages(rows: DataFrame, order: Sequence[str], name: str, page_rows: int) -> DataFrame:
    """Arrays of whole rows per order, in pages of at most ``page_rows``.

    Rows are in ``order``; the other columns break ties, in numbering and in the arrays alike. Orders of one page are grouped as they
    are, which moves each row once. Only the rows of longer ones are numbered over chunks of the whole order and grouped by page.
    """
    rows = rows.filter(F.col("order_id").isNotNull())
    order = _total(rows, order)
    entries = F.sort_array(F.collect_list(F.struct(*order))).alias(name)
    long = stored(rows.groupBy("order_id").agg(F.count("*").alias("_rows")).filter(F.col("_rows") > page_rows).select("order_id"), "long-orders")
    short = rows.join(long, "order_id", "left_anti").groupBy("order_id").agg(entries)
    whole = short.select("order_id", F.lit(0).cast("bigint").alias("page"), name)
    if long.isEmpty():
        return whole
    numbered = with_neighbours(rows.join(long, "order_id", "left_semi"), ["order_id"], order, number="_no")
    page = F.floor((F.col("_no") - 1) / page_rows)
    return whole.unionByName(numbered.groupBy("order_id", page.alias("page")).agg(entries))


def order_documents(orders: DataFrame, items: DataFrame, history: DataFrame, page_rows: int = 1000) -> DataFrame:
    """Each order with arrays of its lines and status changes in time order; the row key is ``(order_id, page)``.

    An order with at most ``page_rows`` lines and changes is one document on page 0. A longer one goes on over
    further pages, so no array and no task grows with the order: to read an order whole, take all its pages.
    All but orders of very many rows are grouped whole beside their order and cut into pages there, so each row is moved once.
    """
    by_time = {"items": ["created_at", "id"], "status_history": ["created_at", "previous_status", "new_status"]}
    tables = {"items": items, "status_history": stored(history, "status-changes")}
    longs = [long for long in (long_keys(rows, "order_id") for rows in tables.values()) if long is not None]
    long = reduce(DataFrame.union, longs).distinct() if longs else None
    split = lambda df, how: df if long is None else df.join(long, "order_id", how)
    documents, pages = split(orders, "left_anti"), F.lit(1)
    for name, rows in tables.items():
        entries = F.sort_array(F.collect_list(F.struct(*_total(rows, by_time[name])))).alias(name)
        documents = documents.join(split(rows.filter(F.col("order_id").isNotNull()), "left_anti").groupBy("order_id").agg(entries), "order_id", "left")
        pages = F.greatest(pages, F.ceil(F.array_size(name) / page_rows))
    page = F.explode(F.sequence(F.lit(0).cast("bigint"), pages - 1)).alias("page")
    cut = lambda name: F.slice(name, (F.col("page") * page_rows + 1).cast("int"), F.lit(page_rows))
    found = documents.select("*", page).select(
        "order_id", *[c for c in orders.columns if c != "order_id"], "page",
        *[F.when(F.col("page") * page_rows < F.array_size(name), cut(name)).alias(name) for name in tables])
    if long is None:
        return found
    lines, changes = (_pages(split(rows, "left_semi"), by_time[name], name, page_rows) for name, rows in tables.items())
    rest = split(orders, "left_semi").join(lines.join(changes, ["order_id", "page"], "full"), "order_id", "left")
    return found.unionByName(rest.withColumn("page", F.coalesce("page", F.lit(0))))
