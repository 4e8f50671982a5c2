"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import shutil
import tempfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The white space of the contracts: 0x20 and 0x09 to 0x0D.
SPACE = " \t\n\x0b\x0c\r"
# Rows of an Arrow batch at most, and its bytes.
BATCH_ROWS, BATCH_BYTES = 2000, 64 << 20
# Labels that a sample takes rows of, at most.
MOST_LABELS = 200


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given parquet tables, by a path that only Spark needs to open."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def free_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not use in any spelling."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def whole_text(text: str = "text") -> Column:
    """The text, with null read as empty."""
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document is kept back from training: crc32 of its id as text leaves remainder 1 by 3.

    A document without an id is held out.
    """
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(True))


def text_slices(batch: pa.RecordBatch, ids: str, text: str, most_bytes: int = 4 << 20) -> Iterator[tuple[list, list[bytes]]]:
    """The ids and UTF-8 texts of a batch in slices of about ``most_bytes``, so that working memory stays level."""
    keys = batch.column(batch.schema.get_field_index(ids)).to_pylist()
    column = batch.column(batch.schema.get_field_index(text)).cast(pa.large_binary())
    some_keys, some_texts, size = [], [], 0
    for key, value in zip(keys, column):
        raw = value.as_py() or b""
        some_keys.append(key)
        some_texts.append(raw)
        size += len(raw)
        if size >= most_bytes:
            yield some_keys, some_texts
            some_keys, some_texts, size = [], [], 0
    if some_keys:
        yield some_keys, some_texts


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def bounded_sample(labelled: DataFrame, label: str, per_label: int, row_id: str = "doc_id", most_labels: int = MOST_LABELS) -> DataFrame:
    """At most ``per_label`` rows of each label: those whose id hashes lowest, so every run picks the same rows.

    The rows of each label are counted first. Of a label with many only hashes below a limit are looked at, which leaves some
    more than ``per_label`` however many it has; the few that are left are ranked. Of more than ``most_labels``
    labels the most frequent are sampled, so the sample is bounded whatever the column holds.
    """
    share, place, rows_of = (free_name(labelled, n) for n in ("hash_share", "place", "rows_of_label"))
    counts = labelled.groupBy(label).agg(F.count("*").alias(rows_of)).orderBy(F.desc(rows_of), label).limit(most_labels)
    # Four standard deviations and more above what is wanted.
    wanted = F.lit(float(per_label + 6 * per_label**0.5 + 40))
    hashed = (F.xxhash64(F.col(row_id)).cast("double") / 2.0**64) + 0.5
    few = (labelled.join(F.broadcast(counts), label).withColumn(share, hashed).filter(F.col(share) * F.col(rows_of) <= wanted))
    order = Window.partitionBy(label).orderBy(share, F.col(row_id))
    return few.withColumn(place, F.row_number().over(order)).filter(F.col(place) <= per_label).select(*labelled.columns)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per application, so that tasks can import it."""
    context = spark.sparkContext
    root = Path(__file__).resolve().parents[2]
    if context.applicationId in _SHIPPED or not (root / "shoplight").is_dir():
        return
    archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='shoplight-code-')}/shoplight", "zip", root, "shoplight")
    context.addPyFile(archive)
    _SHIPPED.add(context.applicationId)


def map_batches(df: DataFrame, function: Callable, schema: str, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """``mapInArrow`` by a function of this package, in batches of whole rows that stay small.

    A batch is closed at the row that reaches ``batch_bytes``; Spark holds some times as much beside its heap while it is filled.
    """
    ship(df.sparkSession)
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{batch_bytes}b")
    return df.mapInArrow(function, schema)
