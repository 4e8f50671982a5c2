"""Best-fit packing of tokenised documents into sequences by bin completion.

How many documents there are of each length is all that the packing depends on, so the search
works on that table of at most ``capacity`` rows, whatever the size of the corpus. It takes
the largest length left, enumerates the undominated fillings of the room around it, applies one as
often as there are documents for it, and goes on, depth first. A branch whose waste exceeds what a
better solution could have is cut. The incumbent is the best-fit-decreasing packing, itself made on
the table. Spark counts the lengths, numbers the documents of a length, and joins them to
their places.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shoplight.llm.common import map_batches, table, text_slices
from shoplight.session import prepare, stored

CAPACITY = 4096
END_ID = 1
# Words whose ids one task keeps; beyond that it starts over.
CACHED_WORDS, CACHED_BYTES = 300_000, 48 << 20
# Effort of the search: fillings tried in all, fillings kept per step and steps per filling.
SEARCH_STEPS, FILLINGS, FILLING_STEPS = 30_000, 6, 2_000
# Ranks of a length that share a join key.
BLOCK = 1024

Pattern = tuple[tuple[int, int], ...]  # (length, how many of it in one sequence), longest first


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


# Characters whose lower case, composition and class are the same everywhere: printable ASCII and the letters of Latin-1 and Latin Extended-A.
_PLAIN = "!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u0148\u014a-\u017e"
_LOWER = "a-z\u00df-\u00f6\u00f8-\u017e"
PLAIN_TEXT = re.compile(rf"[{_PLAIN} \t-\r]*")
# The vocabulary's own word rule over such characters in lower case (fixed values).
WORD = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LOWER}]+|[0-9]|[^\s0-9{_LOWER}]+")


class WordIds:
    """The ids of a text, as little-endian unsigned 32-bit words.

    The vocabulary drops white space, and neither its normaliser nor its pieces see across words, so
    the ids of a text are those of its words in turn. Words come back all the time; each is
    given to the library once per filling of the cache, many in one call: the last piece of a word
    has an end mark. Text with characters beyond ``PLAIN_TEXT`` is given to the library by whole
    stretches between white space.
    """

    def __init__(self, path: str) -> None:
        self.tokenizer = _tokenizer(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        self.words: dict[str, bytes] = {}
        self.stretches: dict[str, bytes] = {}
        self.size = 0

    def learn_words(self, new: list[str]) -> None:
        for start in range(0, len(new), 8192):
            some = new[start : start + 8192]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, dtype="<u4")
            cuts = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            if len(cuts) != len(some):
                raise ValueError("the vocabulary's word rule differs from the expected one")
            raw = ids.tobytes()
            self.words.update(zip(some, [raw[a:b] for a, b in zip([0, *cuts], cuts)]))
            self.size += len(raw) + sum(map(len, some))

    def learn_stretches(self, new: list[str]) -> None:
        for start in range(0, len(new), 1024):
            some = new[start : start + 1024]
            for stretch, found in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False)):
                self.stretches[stretch] = np.array(found.ids, dtype="<u4").tobytes()
                self.size += 5 * len(found.ids) + len(stretch)

    def of(self, texts: list[bytes]) -> list[bytes]:
        if len(self.words) + len(self.stretches) > CACHED_WORDS or self.size > CACHED_BYTES:
            self.forget()
        plain, other = [], []
        for raw in texts:
            text = raw.decode("utf-8", "replace")
            # "<|" may begin a special piece.
            ordinary = PLAIN_TEXT.fullmatch(text) and "<|" not in text
            plain.append(WORD.findall(text.lower()) if ordinary else None)
            other.append(None if ordinary else re.split("[ \t-\r]+", text))
        if new := set().union(*filter(None, plain)).difference(self.words):
            self.learn_words(list(new))
        if new := set().union(*filter(None, other)).difference(self.stretches):
            self.learn_stretches(list(new))
        return [b"".join(map(self.stretches.__getitem__, rest) if words is None else map(self.words.__getitem__, words))
                for words, rest in zip(plain, other)]


PIECES = ("doc_id long, piece int, start long, length long, ids_crc32 long, part int, local_rank long")


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece, numbered among the pieces of its length in its task."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        words = WordIds(vocabulary)
        seen: dict[int, int] = {}
        end = np.array([END_ID], dtype="<u4").tobytes()
        for batch in batches:
            for keys, texts in text_slices(batch, "doc_id", "text", 1 << 20):
                rows = []
                for key, ids in zip(keys, words.of(texts)):
                    ids += end
                    for number, at in enumerate(range(0, len(ids), 4 * capacity)):
                        own = ids[at : at + 4 * capacity]
                        length = len(own) // 4
                        rank = seen.get(length, 0)
                        seen[length] = rank + 1
                        rows.append((key, number, at // 4, length, zlib.crc32(own), part, rank))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()))],
                    names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "local_rank"])

    chosen = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return map_batches(chosen, cut, PIECES)


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Best-fit decreasing on the table of lengths: (pattern, how many sequences of it)."""
    room: dict[int, list[list]] = {}  # free room: [pattern, sequences]
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            free = min((r for r in room if r >= length), default=None)
            if free is None:
                # New sequences, each filled with as many of this length as fit.
                each = min(capacity // length, left)
                new = left // each
                room.setdefault(capacity - each * length, []).append([((length, each),), new])
                left -= new * each
                continue
            pattern, many = room[free].pop()
            if not room[free]:
                del room[free]
            each = min(free // length, left)
            used = min(many, left // each)
            room.setdefault(free - each * length, []).append([(*pattern, (length, each)), used])
            if used < many:
                room.setdefault(free, []).append([pattern, many - used])
            left -= used * each
    return [(pattern, many) for groups in room.values() for pattern, many in groups]


def fillings(counts: dict[int, int], lengths: list[int], room: int, most_waste: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Undominated fillings of ``room``, as (waste, [(length, how many)]), least waste first.

    A filling is dominated when one of its documents, or none, can be replaced by a longer one that is left.
    """
    found: list[tuple[int, list[tuple[int, int]]]] = []
    steps = [0]

    def undominated(chosen: list[tuple[int, int]], slack: int) -> bool:
        taken = dict(chosen)
        for base in {0, *taken}:
            at = bisect_right(lengths, base + slack) - 1
            while at >= 0 and lengths[at] > base:
                if counts[lengths[at]] > taken.get(lengths[at], 0):
                    return False
                at -= 1
        return True

    def fill(left: int, top: int, chosen: list[tuple[int, int]]) -> None:
        steps[0] += 1
        if steps[0] > FILLING_STEPS or len(found) >= FILLINGS:
            return
        if left and counts.get(left, 0) and left < top:
            found.append((0, [*chosen, (left, 1)]))
            return
        at = bisect_right(lengths, min(left, top - 1)) - 1
        if left <= most_waste and undominated(chosen, left):
            found.append((left, list(chosen)))
        while at >= 0 and steps[0] <= FILLING_STEPS and len(found) < FILLINGS:
            length = lengths[at]
            for many in range(min(left // length, counts[length]), 0, -1):
                fill(left - many * length, length, [*chosen, (length, many)])
                if steps[0] > FILLING_STEPS or len(found) >= FILLINGS:
                    break
            at -= 1

    fill(room, room + 1, [])
    return sorted(found, key=lambda x: x[0])


def completed(counts: dict[int, int], capacity: int, target: int, budget: int) -> list[tuple[Pattern, int]] | None:
    """Bin completion: a packing into at most ``target`` sequences, or None when none was found within the budget."""
    left = dict(counts)
    lengths = sorted(left)
    allowed = target * capacity - sum(n * c for n, c in counts.items())
    path: list[tuple[Pattern, int, int]] = []  # what was applied, and the waste before it
    choices: list[list] = []
    waste = 0

    def change(pattern: Pattern, times: int) -> None:
        for length, many in pattern:
            before = left[length]
            left[length] = before + many * times
            if before == 0:
                lengths.insert(bisect_right(lengths, length), length)
            elif left[length] == 0:
                lengths.remove(length)

    while lengths:
        if len(choices) == len(path):
            largest = lengths[-1]
            left[largest] -= 1
            if not left[largest]:
                lengths.pop()
            options = fillings(left, lengths, capacity - largest, allowed - waste)
            left[largest] += 1
            if lengths[-1:] != [largest]:
                lengths.append(largest)
            choices.append([(w, merged(largest, f)) for w, f in reversed(options)])
        budget -= 1
        if budget < 0:
            return None
        if not choices[-1]:
            choices.pop()
            if not path:
                return None
            pattern, times, waste = path.pop()
            change(pattern, times)
            continue
        lost, pattern = choices[-1].pop()
        times = min(left[length] // many for length, many in pattern)
        if lost:
            times = min(times, (allowed - waste) // lost)
        if times < 1:
            continue
        change(pattern, -times)
        path.append((pattern, times, waste))
        waste += lost * times
    return [(pattern, times) for pattern, times, _ in path]


def merged(largest: int, filling: list[tuple[int, int]]) -> Pattern:
    if filling and filling[0][0] == largest:
        return ((largest, filling[0][1] + 1), *filling[1:])
    return ((largest, 1), *filling)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[Pattern, int]]:
    """The packing of a table of lengths: the best of best-fit and bin completion.

    Targets rise from the lower bound (all room used) towards the incumbent in growing steps. Those between the last that
    failed and the first that was reached, or the incumbent, are bisected. Each target has a share of ``SEARCH_STEPS``, so
    one that fails is not proven impossible.
    """
    if not counts:
        return []
    if max(counts) > capacity or min(counts) < 1:
        raise ValueError("a length is outside 1 to the capacity")
    incumbent = best_fit(counts, capacity)
    best = sum(times for _, times in incumbent)
    bound = -(-sum(n * c for n, c in counts.items()) // capacity)
    # Lengths above half the capacity never share a sequence.
    bound = max(bound, sum(c for n, c in counts.items() if 2 * n > capacity))
    effort = max(2 * len(counts), SEARCH_STEPS // max(1, min(best - bound, 8)))
    failed, target, step = bound - 1, bound, 1
    rising = True
    while failed + 1 < best:
        found = completed(counts, capacity, target, effort)
        if found is not None:
            incumbent, best, rising = found, sum(times for _, times in found), False
        else:
            failed = target
        target, step = target + step, 2 * step
        rising = rising and target < best
        if not rising:
            target = (failed + best) // 2
    return incumbent


def slots(patterns: list[tuple[Pattern, int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, how many in a sequence, sequences, first sequence, offset) for each pattern and length."""
    ranks: dict[int, int] = {}
    rows, base = [], 0
    for pattern, times in patterns:
        offset = 0
        for length, many in pattern:
            first = ranks.get(length, 0)
            rows.append((length, first, many, times, base, offset))
            ranks[length] = first + many * times
            offset += many * length
        base += times
    return rows


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece of every document.

    A null or empty text is the end id alone, one piece of length 1. Longer documents than the
    capacity are cut into full pieces and a rest. Repeated rows are packed each for itself, a null
    id stays null, an empty table gives an empty table, other columns are not read.

    The driver sees one count per length, at most ``capacity`` rows; the documents are
    numbered by their task and its offset, and joined to places by length and block of ranks.
    """
    spark = docs.sparkSession
    items = stored(pieces(docs, vocabulary, capacity, doc_id, text), "pieces")
    each = stored(items.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = each.withColumn("ahead", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    counts = {r["length"]: r["n"] for r in each.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = spark.createDataFrame(
        slots(plan(counts, capacity)),
        "length long, first long, many long, times long, base long, at long")
    # One row for each block of ranks that a place spans; long places are cut into equal spans first.
    blocks = (places.withColumn("last", F.col("first") + F.col("many") * F.col("times") - 1)
              .withColumn("block", F.explode(F.expr(f"sequence(first div {BLOCK}, last div {BLOCK})"))))
    # Both tables grow with the input, however small they look beside it: they are never broadcast.
    ranked = (items.join(offsets.hint("merge"), ["part", "length"]).withColumn("rank", F.col("ahead") + F.col("local_rank"))
              .withColumn("block", F.expr(f"rank div {BLOCK}")))
    placed = ranked.join(blocks.hint("merge"), ["length", "block"]).filter("rank BETWEEN first AND last")
    inside = F.col("rank") - F.col("first")
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("base") + F.floor(inside / F.col("many"))).cast("long").alias("sequence_id"),
        (F.col("at") + inside % F.col("many") * F.col("length")).cast("long").alias("offset"))


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place."""
    return pack(table(prepare(spark), sf_dir, "documents"), vocabulary_path())
