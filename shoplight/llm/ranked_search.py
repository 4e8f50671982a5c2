"""Ranked word search through k2-treaps over blocks of documents.

The index has one row per block of documents: their ids, the sorted words that occur in them, and a treap over
the grid of words and documents, whose points are the impacts of a word in a document. An impact needs two numbers
of the whole corpus, which are counted first. A search asks each block for the best documents of each item; a task
carries what it has found from block to block, so later blocks open fewer cells. The best of all tasks
are the result. Every document is indexed with all its words, and no bound on candidates is set.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shoplight.llm.common import map_batches, table, text_slices
from shoplight.llm.treap import Treap, small
from shoplight.session import prepare, work_dir

TOP = 20
# A block is closed at so many documents or bytes of text.
BLOCK_DOCS, BLOCK_BYTES = 1024, 3 << 19
# Bytes of a row group of the index, of which a task holds one at a time; a batch of blocks has half as many.
GROUP_BYTES = 8 << 20
# Bytes of a text that are cut into words at once, and items that are searched together.
SLICE_BYTES, ITEMS = 4 << 20, 2000
# Parts that the results of tasks are dealt to before the last ranking.
SALTS = 32
LAST_NAME = np.iinfo(np.int64).max

# Digits, letters in lower case and all bytes of other scripts stay; everything else separates words.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
INDEX = ("ids array<long>, words array<binary>, holders array<binary>, holder_width int, height int, masks array<binary>, "
         "impacts array<binary>, impact_width int")
# Bytes of a piece of a long value: files are written and read by pages, and a page holds whole values.
PIECE_BYTES = 128 << 10


def in_pieces(raw: bytes) -> pa.Array:
    """One row that holds a long value in pieces."""
    return pa.array([[raw[a : a + PIECE_BYTES] for a in range(0, len(raw), PIECE_BYTES)]], pa.list_(pa.binary()))


def joined(value: pa.ListScalar) -> bytes:
    return b"".join(value.as_py())


def words_of(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, some megabytes of it at a time."""
    at = 0
    while at < len(text):
        end = at + SLICE_BYTES
        part = text[at:end].translate(_WORDS)
        # A word that reaches over the end belongs to the next slice, however long it is.
        while end < len(text) and (cut := part.rfind(b" ")) < 0:
            part += text[end : end + SLICE_BYTES].translate(_WORDS)
            end += SLICE_BYTES
        if end < len(text):
            part = part[: cut + 1]
        yield part.split()
        at += len(part)


def sizes(docs: DataFrame, doc_id: str, text: str) -> tuple[int, int]:
    """The number of documents that hold a word, and the number of all their words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holding = total = 0
        for batch in batches:
            for _, texts in text_slices(batch, "doc_id", "text"):
                for one in texts:
                    n = sum(map(len, words_of(one)))
                    holding += n > 0
                    total += n
        yield pa.RecordBatch.from_pydict({"holding": pa.array([holding], pa.int64()), "total": pa.array([total], pa.int64())})

    row = map_batches(_chosen(docs, doc_id, text), run, "holding long, total long").agg(F.sum("holding"), F.sum("total")).head()
    return int(row[0] or 0), int(row[1] or 0)


def _chosen(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))


def index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, int]:
    """The written index of all documents, and how many of them hold a word."""
    holding, total = sizes(docs, doc_id, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[int, bool, int, np.ndarray, np.ndarray]] = []
        vocabulary: dict[bytes, int] = {}
        size = 0
        for batch in batches:
            for keys, texts in text_slices(batch, "doc_id", "text", 1 << 20):
                for key, one in zip(keys, texts):
                    counts: Counter = Counter()
                    for some in words_of(one):
                        counts.update(some)
                    if counts:
                        held = np.array([vocabulary.setdefault(w, len(vocabulary)) for w in counts], dtype=np.int32)
                        tf = np.fromiter(counts.values(), dtype=np.int64, count=len(counts))
                        rows.append((LAST_NAME if key is None else key, key is None, int(tf.sum()), held, small(tf)))
                        size += len(one)
                    if len(rows) >= BLOCK_DOCS or size >= BLOCK_BYTES:
                        yield block(rows, vocabulary)
                        rows, vocabulary, size = [], {}, 0
        if rows:
            yield block(rows, vocabulary)

    def block(rows: list[tuple[int, bool, int, np.ndarray, np.ndarray]], vocabulary: dict[bytes, int]) -> pa.RecordBatch:
        rows.sort(key=lambda r: r[:2])
        words = sorted(vocabulary)
        place = np.empty(len(words), dtype=np.int64)
        place[[vocabulary[w] for w in words]] = np.arange(len(words))
        each = np.array([len(r[3]) for r in rows])
        row, tf = place[np.concatenate([r[3] for r in rows])], np.concatenate([r[4].astype(np.int64) for r in rows])
        length = np.array([75 + (25 * r[2] * holding) // total for r in rows], dtype=np.int64)
        impact = (1_000_000_000 * tf) // (1000 * tf + 12 * np.repeat(length, each))
        treap = Treap.build(row, np.repeat(np.arange(len(rows)), each), impact)
        masks, impacts, width = treap.packed()
        holders = small(np.bincount(row, minlength=len(words)))
        return pa.RecordBatch.from_arrays([
            pa.array([[None if r[1] else r[0] for r in rows]], pa.list_(pa.int64())),
            in_pieces(b" ".join(words)), in_pieces(holders.tobytes()), pa.array([holders.itemsize], pa.int32()),
            pa.array([treap.height], pa.int32()), in_pieces(masks), in_pieces(impacts), pa.array([width], pa.int32())],
            names=["ids", "words", "holders", "holder_width", "height", "masks", "impacts", "impact_width"])

    path = work_dir(docs.sparkSession, "word-index")
    map_batches(_chosen(docs, doc_id, text), run, INDEX).write.option("parquet.block.size", GROUP_BYTES).parquet(path)
    return docs.sparkSession.read.schema(INDEX).parquet(path), holding


@dataclass
class Items:
    """Some items: their words as places in one sorted list, and how often each occurs."""

    names: list[int | None]
    words: list[bytes]
    places: list[np.ndarray]
    counts: list[np.ndarray]

    @staticmethod
    def of(rows: list[tuple[int | None, str | None]]) -> Items:
        every = []
        for _, text in rows:
            counts: Counter = Counter()
            for some in words_of((text or "").encode()):
                counts.update(some)
            every.append(counts)
        words = sorted(set().union(*every))
        at = {w: i for i, w in enumerate(words)}
        return Items([name for name, _ in rows], words, [np.array([at[w] for w in c], dtype=np.int64) for c in every],
                     [np.array(list(c.values()), dtype=np.int64) for c in every])


def places_of(words: list[bytes], own: bytes) -> np.ndarray:
    """The place of each word among a block's own words, which stand in one text; -1 where it has none."""
    here = {w: i for i, w in enumerate(own.split(b" "))}
    return np.array([here.get(w, -1) for w in words], dtype=np.int64)


def holders_of(blocks: DataFrame, words: list[bytes]) -> np.ndarray:
    """How many documents hold each word."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(len(words), dtype=np.int64)
        for batch in batches:
            for own, raw, width in zip(*(batch.column(c) for c in ("words", "holders", "holder_width"))):
                local = places_of(words, joined(own))
                found += np.where(local >= 0, np.frombuffer(joined(raw), dtype=f"<u{width}").astype(np.int64)[np.maximum(local, 0)], 0)
        there = np.flatnonzero(found)
        yield pa.RecordBatch.from_pydict({"word": pa.array(there, pa.int64()), "holders": pa.array(found[there], pa.int64())})

    rows = map_batches(blocks.select("words", "holders", "holder_width"), run, "word long, holders long", GROUP_BYTES // 2).groupBy("word").agg(F.sum("holders")).collect()
    counts = np.zeros(len(words), dtype=np.int64)
    for word, n in rows:
        counts[word] = n
    return counts


def weights_of(holders: np.ndarray, holding: int) -> np.ndarray:
    """The weight of a word: the floor of 1000 ln((2 N + 2) / (2 df + 1))."""
    return np.array([math.floor(1000 * math.log((2 * holding + 2) / (2 * int(df) + 1))) for df in holders], dtype=np.int64)


def best(blocks: DataFrame, items: Items, weights: np.ndarray, top: int) -> DataFrame:
    """(item, doc_id, score): of each item the ``top`` best of every task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[list[tuple[int, int, bool]]] = [[] for _ in items.names]
        for batch in batches:
            for ids, own, height, masks, impacts, width in zip(*(batch.column(c) for c in ("ids", "words", "height", "masks", "impacts", "impact_width"))):
                local = places_of(items.words, joined(own))
                treap = Treap.unpacked(height.as_py(), joined(masks), joined(impacts), width.as_py())
                known = ids.as_py()
                no_id = [i is None for i in known]
                names = np.array([LAST_NAME if i is None else i for i in known], dtype=np.int64)
                for i, (places, counts) in enumerate(zip(items.places, items.counts)):
                    there = local[places] >= 0
                    if there.any():
                        so_far = found[i]
                        least = (so_far[-1][0], so_far[-1][1]) if len(so_far) == top else None
                        new = treap.search(local[places[there]], weights[places[there]] * counts[there], top, names, least)
                        so_far += [(score, int(names[c]), no_id[c]) for score, c in new]
                        so_far.sort(key=lambda x: (-x[0], x[1], x[2]))
                        del so_far[top:]
        rows = [(i, None if no_id else name, score) for i, some in enumerate(found) for score, name, no_id in some]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["item", "doc_id", "score"])

    return map_batches(blocks.drop("holders", "holder_width"), run, "item long, doc_id long, score long", GROUP_BYTES // 2)


def ranked(blocks: DataFrame, holding: int, items: DataFrame, item_id: str = "item_id", text: str = "text", top: int = TOP) -> DataFrame:
    """item_id, rank, doc_id and score of the ``top`` best documents of each item.

    Items are read and searched in blocks of ``ITEMS``, so neither the driver nor a task holds more of them. The texts of an id that
    comes with several are taken together. A null or empty item finds nothing. Equal scores are ranked by doc_id, documents
    without an id last; repeated documents are ranked side by side.
    """
    spark = blocks.sparkSession
    asked = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(text).cast("string").alias("text")).groupBy("item_id").agg(
        F.concat_ws(" ", F.sort_array(F.collect_set("text"))).alias("text"))
    results, some = [], []
    for row in asked.toLocalIterator():
        some.append((row["item_id"], row["text"]))
        if len(some) == ITEMS:
            results.append(_ranked(spark, blocks, holding, Items.of(some), top))
            some = []
    if some or not results:
        results.append(_ranked(spark, blocks, holding, Items.of(some), top))
    whole = results[0]
    for more in results[1:]:
        whole = whole.unionByName(more)
    return whole


def _ranked(spark: SparkSession, blocks: DataFrame, holding: int, items: Items, top: int) -> DataFrame:
    weights = weights_of(holders_of(blocks, items.words), holding) if items.words else np.zeros(0, dtype=np.int64)
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    rows = best(blocks, items, weights, top).withColumn("part", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    for keys in (["item", "part"], ["item"]):
        rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= top)
    names = spark.createDataFrame(list(enumerate(items.names)), "item long, item_id long")
    return rows.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents for each benchmark item."""
    blocks, holding = index(table(prepare(spark), sf_dir, "documents"))
    return ranked(blocks, holding, table(spark, sf_dir, "benchmark"))


_SQL_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
SQL = rf"""
WITH words AS (SELECT row_number() OVER () AS row, doc_id, unnest({_SQL_WORDS}) AS word FROM (SELECT doc_id, text FROM documents)),
lengths AS (SELECT row, doc_id, count(*) AS n FROM words GROUP BY ALL),
corpus AS (SELECT count(*)::HUGEINT AS docs, sum(n)::HUGEINT AS total FROM lengths),
counts AS (SELECT row, word, count(*) AS tf FROM words GROUP BY ALL),
asked AS (SELECT item_id, unnest({_SQL_WORDS}) AS word FROM benchmark),
weights AS (
    SELECT word, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(row) + 1)::DOUBLE))::BIGINT AS w
    FROM (SELECT DISTINCT word FROM asked) LEFT JOIN counts USING (word), corpus GROUP BY word),
scores AS (
    SELECT item_id, row, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // total))))::BIGINT AS score
    FROM asked JOIN weights USING (word) JOIN counts USING (word) JOIN lengths USING (row), corpus GROUP BY ALL),
numbered AS (
    SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM numbered WHERE rank <= {TOP}"""
