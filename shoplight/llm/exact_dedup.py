"""Exact deduplication with a heavy-hitter split.

A Misra-Gries summary (Spark's ``approx_top_k`` sketches: counters that are decremented together
when there are too many) finds the digests that may be frequent. Their winners are then computed
exactly over all rows, with partial sums in each task, and broadcast: at most ``HEAVY`` rows. The
rows of frequent digests are settled on the map side, so a group that holds a third of the table
is never shuffled. All other digests have few rows and are settled by one ordinary shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shoplight.llm.common import SPACE, free_name, table, whole_text
from shoplight.session import prepare, stored

# Frequent digests that are settled by broadcast: at most this many rows of about 100 bytes.
HEAVY = 1000
# Counters of each sketch. A digest that holds more than one row in about 3000 is always found.
COUNTERS = 8192
# First-level sketches that are merged into the last one, so that no task merges one per input task.
MERGERS = 64


def normalised(text: str) -> Column:
    """The text without the white space of the contract."""
    return F.translate(whole_text(text), SPACE, "")


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One small row per document: its id, digest, number of code points and a row number that breaks last ties."""
    return docs.select(
        F.col(doc_id).alias("doc_id"),
        F.unhex(F.sha2(normalised(text), 256)).alias("digest"),
        F.length(whole_text(text)).cast("long").alias("n_points"),
        F.monotonically_increasing_id().alias("row_no"))


def frequent(rows: DataFrame) -> DataFrame:
    """Candidates (key): 64-bit hashes of digests that may be frequent, at most ``HEAVY`` of them."""
    keys = rows.select(F.xxhash64("digest").alias("key"), (F.spark_partition_id() % MERGERS).alias("merger"))
    parts = keys.groupBy("merger").agg(F.expr(f"approx_top_k_accumulate(key, {COUNTERS})").alias("part"))
    # A grouped sum: a sum over everything would also merge a state without a type from each empty task.
    top = parts.groupBy(F.col("merger") < 0).agg(F.expr(f"approx_top_k_combine(part, {COUNTERS})").alias("part")).select(
        F.explode(F.expr(f"approx_top_k_estimate(part, {HEAVY})")).alias("top"))
    # A digest of one row is never frequent.
    return top.filter("top.count > 1").select(F.col("top.item").alias("key"))


# The largest of these is the row that stays: most code points, then smallest id (null last), then first row.
ORDER = "struct(n_points, doc_id IS NOT NULL AS known, -doc_id AS minus_id, -row_no AS minus_row)"


def keepers(rows: DataFrame) -> DataFrame:
    """Each row of ``digests`` with keep_id, keep_row and group_size.

    ``rows`` is read several times, so it should be a stored table.
    """
    candidates = F.broadcast(frequent(rows))
    winners = (rows.withColumn("key", F.xxhash64("digest")).join(candidates, "key", "left_semi")
               .groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"), F.max(F.expr(ORDER)).alias("top"))
               .select("digest", "group_size", (-F.col("top.minus_id")).alias("keep_id"), (-F.col("top.minus_row")).alias("keep_row")))
    heavy = F.broadcast(stored(winners, "heavy-digests"))
    marked = rows.join(heavy, "digest", "left")
    settled = marked.filter("group_size IS NOT NULL")
    group = Window.partitionBy("digest")
    rest = (marked.filter("group_size IS NULL").drop("group_size", "keep_id", "keep_row")
            .withColumn("group_size", F.count(F.lit(1)).over(group))
            .withColumn("top", F.max(F.expr(ORDER)).over(group))
            .withColumn("keep_id", -F.col("top.minus_id")).withColumn("keep_row", -F.col("top.minus_row")).drop("top"))
    columns = ["doc_id", "digest", "n_points", "row_no", "keep_id", "keep_row", "group_size"]
    return settled.select(columns).unionByName(rest.select(columns))


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row.

    Null counts as empty text, and all texts of white space alone are equal to it. A row without
    an id loses ties against one with an id; rows that agree in everything leave one of them.
    Of each group exactly one row is kept. An empty table gives an empty table; other columns are
    not read. ``doc_id`` is a number.
    """
    rows = stored(digests(docs, doc_id, text), "digests")
    return keepers(rows).select(
        "doc_id", "keep_id", "group_size", (F.col("row_no") == F.col("keep_row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"))


def without_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Only the small digest rows go through the heavy-hitter split; the documents are joined to the
    decisions once, on id and digest. Rows that agree in id, digest and length are one document
    and leave one row.
    """
    prepare(docs.sparkSession)
    key, points = free_name(docs, "dedup_digest"), free_name(docs, "dedup_points")
    rows = stored(digests(docs, doc_id, text), "digests")
    winners = keepers(rows).filter("row_no = keep_row").select(
        F.col("doc_id").alias(f"{key}_id"), F.col("digest").alias(f"{key}_w"), F.col("n_points").alias(f"{points}_w"))
    with_key = docs.withColumn(key, F.unhex(F.sha2(normalised(text), 256))).withColumn(
        points, F.length(whole_text(text)).cast("long"))
    found = with_key.join(winners, (F.col(doc_id).eqNullSafe(F.col(f"{key}_id"))) & (F.col(key) == F.col(f"{key}_w"))
                          & (F.col(points) == F.col(f"{points}_w")), "left_semi")
    return found.dropDuplicates([doc_id, key, points]).select(*docs.columns)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The decision on every document."""
    return exact_groups(table(prepare(spark), sf_dir, "documents"))


SQL = r"""
WITH docs AS (
    SELECT doc_id, coalesce(text, '') AS body, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
    FROM documents),
ranked AS (
    SELECT doc_id, text_sha256, count(*) OVER (PARTITION BY text_sha256) AS group_size,
           first_value(doc_id) OVER w AS keep_id, row_number() OVER w AS place
    FROM docs WINDOW w AS (PARTITION BY text_sha256 ORDER BY length(body) DESC, doc_id ASC NULLS LAST))
SELECT doc_id, keep_id, group_size, place = 1 AS kept, text_sha256 FROM ranked"""
