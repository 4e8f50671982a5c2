"""Data-quality checks; each gives one row per rule with rows checked and rows in breach."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType


def _report(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """One pass over ``df`` that counts the breaches of every rule."""
    names = list(rules)
    counts = df.agg(
        F.count("*").alias("_rows"), *[F.count_if(rule).alias(f"_rule_{i}") for i, rule in enumerate(rules.values())]
    )
    entries = F.array(*[
        F.struct(F.lit(n).alias("rule"), F.col(f"_rule_{i}").alias("violations")) for i, n in enumerate(names)
    ])
    return counts.select("_rows", F.explode(entries).alias("e")).select(
        "e.rule", F.col("_rows").alias("checked_rows"), "e.violations"
    )


def check_not_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows per required column where it is NULL."""
    return _report(df, {f"not_null:{c}": F.col(c).isNull() for c in columns})


def check_domain(df: DataFrame, domains: dict[str, Sequence[str]]) -> DataFrame:
    """Rows per column with a value outside its list; NULL passes."""
    return _report(df, {f"domain:{c}": ~F.col(c).isin(*values) for c, values in domains.items()})


def check_range(df: DataFrame, ranges: dict[str, tuple]) -> DataFrame:
    """Rows per column with a value outside its range; NULL passes."""
    return _report(df, {f"range:{c}": ~F.col(c).between(lo, hi) for c, (lo, hi) in ranges.items()})


def check_unique(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Repeated keys and the rows beyond the first of each; a key with a NULL repeats nothing. Map tasks count before the shuffle."""
    set_key = reduce(Column.__and__, [F.col(k).isNotNull() for k in key])
    counts = df.groupBy(*key).agg(F.count("*").alias("_rows")).withColumn("_set", set_key)
    return counts.agg(
        F.coalesce(F.sum("_rows"), F.lit(0)).alias("checked_rows"),
        F.count_if(F.col("_set") & (F.col("_rows") > 1)).alias("repeated_keys"),
        F.coalesce(F.sum(F.when(F.col("_set"), F.col("_rows") - 1)), F.lit(0)).alias("violations"),
    ).select(F.lit("unique:" + ",".join(key)).alias("rule"), "*")


def check_fk(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Child rows whose key is set but missing in the parent."""
    return check_fks([(child, parent, child_key, parent_key)])


def check_fks(relations: Sequence[tuple[DataFrame, DataFrame, str, str]]) -> DataFrame:
    """Child rows whose key is set but missing in the parent, for relations (child, parent, child key, parent key).

    The keys of all children and parents, each with the number of its relation, meet in one aggregate: one shuffle for
    all rules, and map tasks count a child's repeated keys before it. Whole numbers are compared as such, other keys as texts.
    """
    tagged = []
    for number, (child, parent, child_key, parent_key) in enumerate(relations):
        whole = all(isinstance(df.schema[key].dataType, IntegralType) for df, key in ((child, child_key), (parent, parent_key)))
        for df, key, rows in ((child, child_key, 1), (parent, parent_key, 0)):
            tagged.append(df.filter(F.col(key).isNotNull()).select(
                F.lit(number).alias("_relation"), (F.col(key) if whole else F.lit(None)).cast("bigint").alias("_number"),
                (F.lit(None) if whole else F.col(key)).cast("string").alias("_text"), F.lit(rows).cast("bigint").alias("_rows"),
                F.lit(int(rows == 0)).alias("_is_known")))
    # Sums of numbers only, so that the aggregate keeps its rows in place.
    keys = reduce(DataFrame.unionAll, tagged).groupBy("_relation", "_number", "_text").agg(
        F.sum("_rows").alias("_rows"), (F.max("_is_known") > 0).alias("_known"))
    orphan = ~F.col("_known")
    figures = [F.struct(F.count_if(orphan & (F.col("_relation") == n)).alias("orphan_keys"),
                        F.coalesce(F.sum(F.when(orphan & (F.col("_relation") == n), F.col("_rows"))), F.lit(0)).alias("violations")).alias(f"_{n}")
               for n in range(len(relations))]
    counts = keys.agg(*figures)
    entries = F.array(*[F.struct(F.lit(f"foreign_key:{key}").alias("rule"), f"_{n}.orphan_keys", f"_{n}.violations")
                        for n, (_, _, key, _) in enumerate(relations)])
    return counts.select(F.inline(entries))


def check_order_totals(orders: DataFrame, items: DataFrame) -> DataFrame:
    """Orders whose total is not subtotal + tax + shipping, and whose lines do not add up to the subtotal."""
    lines = items.groupBy("order_id").agg(F.sum("total_price").alias("_lines"))
    both = orders.join(lines, "order_id", "left")
    parts = F.col("subtotal") + F.col("tax_amount") + F.col("shipping_cost")
    return _report(both, {
        "total:parts": F.col("total_amount") != parts,
        "total:lines": ~F.col("_lines").eqNullSafe(F.col("subtotal")),
    })


def propagate_delete(child: DataFrame, deleted: DataFrame, key: str, mode: str = "cascade") -> DataFrame:
    """Child rows after a delete in the parent: dropped (``cascade``) or left without key (``set_null``)."""
    if mode not in ("cascade", "set_null"):
        raise ValueError(f"unknown mode {mode!r}")
    gone = deleted.select(F.col(key).alias("_gone")).distinct()
    marked = child.join(gone, F.col(key) == F.col("_gone"), "left_anti" if mode == "cascade" else "left")
    if mode == "cascade":
        return marked
    return marked.withColumn(key, F.when(F.col("_gone").isNull(), F.col(key))).select(*child.columns)
