"""Reports: chosen sections over a date range, and read-only SQL."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoplight.functions.times import moment
from shoplight.operators.games import game_scoreboard
from shoplight.operators.orders import revenue_summary
from shoplight.operators.traffic import user_counts
from shoplight.session import prepare

SECTIONS = ("sales", "games", "users")


def _between(df: DataFrame, ts: str, start: dt.date | None, end: dt.date | None) -> DataFrame:
    """Rows from the start of ``start`` to the end of ``end``."""
    if start is not None:
        df = df.filter(F.col(ts) >= moment(dt.datetime.combine(start, dt.time())))
    if end is not None:
        df = df.filter(F.col(ts) < moment(dt.datetime.combine(end + dt.timedelta(days=1), dt.time())))
    return df


def _long(df: DataFrame, section: str, subject, metrics: list[str]) -> DataFrame:
    """One row per metric of each input row."""
    entries = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])
    return df.select(F.lit(section).alias("section"), subject.alias("subject"), F.explode(entries).alias("e")).select(
        "section", "subject", "e.metric", "e.value"
    )


def build_report(spec: dict, tables: dict[str, DataFrame]) -> DataFrame:
    """A named report as rows ``(section, subject, metric, value)``.

    ``spec`` has ``reportName``, ``metrics`` (any of sales, games, users), and may have ``dateRange``
    (``start`` and ``end`` as ISO dates) and ``filters`` (``category``). Sections that do not
    exist are skipped.
    """
    if not spec.get("reportName") or not spec.get("metrics"):
        raise ValueError("report name and metrics are required")
    dates = spec.get("dateRange") or {}
    start, end = (dt.date.fromisoformat(dates[k]) if dates.get(k) else None for k in ("start", "end"))
    category = (spec.get("filters") or {}).get("category")
    parts: list[DataFrame] = []
    for section in [s for s in SECTIONS if s in spec["metrics"]]:
        if section == "sales":
            orders = _between(tables["orders"], "created_at", start, end)
            parts.append(_long(
                revenue_summary(orders), section, F.lit("all"), ["total_orders", "total_revenue", "average_order_value"]
            ))
        elif section == "games":
            shown, sold = tables["game_interactions"], tables["purchase_events"]
            if category:
                shown = shown.filter(F.lower("game_category") == category.lower())
            board = game_scoreboard(
                _between(shown, "timestamp", start, end), _between(sold, "purchase_timestamp", start, end)
            )
            parts.append(_long(
                board, section, F.col("game_id").cast("string"), ["views", "purchases", "conversion_rate", "revenue"]
            ))
        else:
            events = _between(tables["page_views"], "timestamp", start, end)
            parts.append(_long(
                user_counts(events), section, F.lit("all"), ["total_users", "active_users", "new_users", "returning_users"]
            ))
    if not parts:
        raise ValueError(f"no known section among {spec['metrics']!r}")
    return reduce(DataFrame.unionByName, parts)


# Leaves of a parsed query that read nothing, beside the given tables.
_HARMLESS_LEAVES = {"OneRowRelation", "UnresolvedInlineTable", "LocalRelation"}
_SUBQUERIES = {"ScalarSubquery", "Exists", "ListQuery", "LateralSubquery"}
# Functions that call code outside Spark's own expressions.
_REFUSED_FUNCTIONS = ("reflect", "java_method", "try_reflect")


def _refuse_foreign_relations(plan, known: set[str]) -> None:
    """Walk a parsed query with its subqueries; only ``known`` tables and its own named subqueries may be read."""
    sequence = lambda seq: [seq.apply(i) for i in range(seq.size())]
    kind = plan.nodeName()
    if kind == "UnresolvedWith":
        inner = sequence(plan.innerChildren())
        known = known | {child.alias().lower() for child in inner}
        for child in inner:
            _refuse_foreign_relations(child, known)
    if kind == "UnresolvedRelation":
        name = ".".join(sequence(plan.multipartIdentifier()))
        if name.lower() not in known:
            raise ValueError(f"the query reads {name!r}, which is not among the given tables")
    elif plan.children().isEmpty() and kind not in _HARMLESS_LEAVES:
        raise ValueError(f"the query has a part that is not allowed: {kind}")

    def inside(expression) -> None:
        kind = expression.getClass().getSimpleName()
        if kind in _SUBQUERIES:
            _refuse_foreign_relations(expression.plan(), known)
        elif "Subquery" in kind and kind != "InSubquery":  # that one has its query as a child
            raise ValueError(f"the query has a part that is not allowed: {kind}")
        for child in sequence(expression.children()):
            inside(child)

    for child in sequence(plan.children()):
        _refuse_foreign_relations(child, known)
    for expression in sequence(plan.expressions()):
        inside(expression)


def run_report(spark: SparkSession, sql: str, tables: dict[str, DataFrame], args: dict | None = None) -> DataFrame:
    """Run a read-only query over the given tables; values are passed as named parameters.

    The text must be one query, and read nothing but the tables and its own named subqueries. It runs in a
    session of its own, where files cannot be named as tables and functions that call outside code
    are gone, so the caller's views and settings stay as they are.
    """
    if not sql or not sql.strip():
        raise ValueError("a query is required")
    own = prepare(spark.newSession())
    own.conf.set("spark.sql.runSQLOnFiles", "false")
    state, jvm = own._jsparkSession.sessionState(), own._jvm
    _refuse_foreign_relations(state.sqlParser().parseQuery(sql), {name.lower() for name in tables})
    for name in _REFUSED_FUNCTIONS:
        state.functionRegistry().dropFunction(jvm.org.apache.spark.sql.catalyst.FunctionIdentifier(name))
    for name, df in tables.items():
        jvm.org.apache.spark.sql.classic.Dataset.ofRows(own._jsparkSession, df._jdf.logicalPlan()).createOrReplaceTempView(name)
    return own.sql(sql, args=args or {})
