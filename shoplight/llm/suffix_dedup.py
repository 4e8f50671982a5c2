"""Removal of byte strings that occur earlier, through suffix arrays of shards.

A window is any string of ``WINDOW`` bytes. All windows that could be equal must meet in one shard, and
only text that could repeat should be sorted:

1. The anchor of a window is its byte group of ``GRAM`` bytes with the smallest hash, the leftmost of equals. It
   depends on the window's bytes alone, so equal windows have equal anchors. Neighbouring windows that share
   an anchor form a segment. Each task packs its segments (anchor hash, place, hash of the segment, no text) and deals
   them out by anchor. Of equal segments in one pack only the earliest goes to its anchor; the others are repeats.
2. An anchor that one segment alone has cannot repeat. Equal segments are entered into the arrays as one string,
   for its earliest place; the windows of the others are repeats.
3. Where an anchor has several different segments, their text is fetched, and the shards of such anchors
   get a suffix array by induced sorting and common prefixes in text order. Neighbours in the array with ``WINDOW``
   bytes in common are equal windows; all but the earliest are repeats.
4. An anchor whose different segments are more than one shard is split by its windows: each window is known by a digest
   of its own 100 bytes, partial aggregates give the earliest place of each, and all other windows are repeats.
5. The bytes that repeats cover are merged to spans per document.

Whole copies are settled by a digest of the text first, so a group of copies gives each task few segments.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoplight.llm.common import map_batches, mix, table, text_slices, whole_text
from shoplight.llm.suffix_array import common_prefixes, suffix_array
from shoplight.session import prepare, stored

WINDOW = 100
GRAM = 32
# Bytes of text packed together, segments' owners at most (16-bit numbers), and bytes of one anchor piece of a long text.
PACK_BYTES, PACK_DOCS, PIECE = 4 << 20, 60_000, 1 << 20
# A shard is closed at the first anchor behind so many bytes; an anchor with more is split by its windows.
SHARD_BYTES = 1 << 20
DIGEST_BYTES = 16
NO_ID = 2**63 - 1  # documents without an id come last

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_PLACE_BITS = np.uint64(24)
_PLACE = np.uint64((1 << 24) - 1)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    powers = np.full(n, base, dtype=np.uint64)
    powers[:1] = 1
    return np.cumprod(powers, dtype=np.uint64)


def segments(texts: list[bytes]) -> dict[str, np.ndarray]:
    """The segments of texts of ``WINDOW`` to ``PIECE`` bytes, in order.

    owner: number of the text; start: of the first window; windows: how many; lead: from the start to the
    anchor; anchor and whole: hashes of the anchor and of all bytes of the segment.
    """
    sizes = np.array([len(t) for t in texts])
    base = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    raw = np.frombuffer(b"".join(texts), dtype=np.uint8)
    n = len(raw)
    inverse = _powers(_INVERSE, n)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, n), out=total[1:])
    grams = mix((total[GRAM:] - total[:-GRAM]) * inverse[: n - GRAM + 1])
    least = (grams >> _PLACE_BITS) << _PLACE_BITS | np.arange(len(grams), dtype=np.uint64)
    width, reach = WINDOW - GRAM + 1, 1
    while 2 * reach <= width:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if reach < width:
        least = np.minimum(least[: -(width - reach)], least[width - reach :])
    # Windows within one text: place, and the text it is of.
    counts = sizes - WINDOW + 1
    places = np.arange(counts.sum()) + np.repeat(base - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts)
    of = np.repeat(np.arange(len(texts)), counts)
    anchor = (least[places] & _PLACE).astype(np.int64)
    new = np.flatnonzero((np.diff(anchor, prepend=-1) != 0) | (np.diff(of, prepend=-1) != 0))
    windows = np.diff(new, append=len(places))
    first, at, owner = places[new], anchor[new], of[new]
    end = first + windows - 1 + WINDOW
    return {"owner": owner, "start": first - base[owner], "windows": windows, "lead": at - first, "anchor": grams[at],
            "whole": mix((total[end] - total[first]) * inverse[first])}


FIELDS = {"anchor": "<u8", "whole": "<u8", "start": "<u4", "owner": "<u2", "windows": "u1", "lead": "u1"}


def pieces_of(text: bytes) -> Iterator[tuple[int, bytes]]:
    """A long text in overlapping pieces, so that every window is in one of them."""
    for at in range(0, max(len(text) - WINDOW + 1, 0), PIECE - WINDOW + 1):
        yield at, text[at : at + PIECE]


def keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(id, h, text): rows that agree in id and text are one document."""
    return docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("id"),
                       F.xxhash64(whole_text(text)).alias("h"), whole_text(text).alias("text"))


def dealt_segments(rows: DataFrame) -> DataFrame:
    """(bucket, payload): packed segments by bucket of their anchor; those that repeat within a pack in buckets below 0."""
    spark = rows.sparkSession
    tasks = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = 2 * tasks

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        smallest: dict[tuple[int, int], int] = {}  # of each text given by this task
        for batch in batches:
            keys = list(zip(batch.column("id").to_pylist(), batch.column("h").to_pylist()))
            numbered = pa.RecordBatch.from_arrays([pa.array(range(len(keys)), pa.int64()), batch.column("text")], names=["row", "text"])
            for numbers, texts in text_slices(numbered, "row", "text", PACK_BYTES):
                names: list[tuple[int, int]] = []
                found: list[dict[str, np.ndarray]] = []
                part: list[bytes] = []
                owners: list[int] = []
                bases: list[int] = []
                size = 0
                for number, one in zip(numbers, texts):
                    key, mark = keys[number], (keys[number][1], len(one))
                    # A later copy is removed as a whole; only the text with the smallest id counts.
                    if len(one) < WINDOW or smallest.get(mark, NO_ID + 1) <= key[0]:
                        continue
                    smallest[mark] = key[0]
                    for at, piece in pieces_of(one):
                        part.append(piece)
                        owners.append(len(names))
                        bases.append(at)
                        size += len(piece)
                        if size >= 1 << 20:
                            found.append(_located(part, owners, bases))
                            part, owners, bases, size = [], [], [], 0
                    names.append(key)
                    if len(names) >= PACK_DOCS:
                        found += [_located(part, owners, bases)] if part else []
                        yield _packed(names, found, buckets)
                        names, found, part, owners, bases, size = [], [], [], [], [], 0
                found += [_located(part, owners, bases)] if part else []
                if found:
                    yield _packed(names, found, buckets)

    return map_batches(rows, pack, "bucket int, payload binary").repartition(tasks, "bucket")


def _located(part: list[bytes], owners: list[int], bases: list[int]) -> dict[str, np.ndarray]:
    found = segments(part)
    found["start"] = found["start"] + np.array(bases)[found["owner"]]
    found["owner"] = np.array(owners)[found["owner"]]
    return found


def _later_equals(x: dict[str, np.ndarray], ids: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which segments of a pack are equal to an earlier one in it."""
    key = mix(x["whole"] ^ mix(x["anchor"] + (x["lead"] * 256 + x["windows"]).astype(np.uint64)))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    shared = np.zeros(len(order), dtype=bool)
    shared[1:] |= same
    shared[:-1] |= same
    some = order[shared]
    own = [x[c][some] for c in ("whole", "windows", "lead", "anchor")]
    owner = x["owner"][some]
    turn = np.lexsort((x["start"][some], hashes[owner], ids[owner], *own))
    later = np.zeros(len(order), dtype=bool)
    later[some[turn[1:]]] = np.all([v[turn][1:] == v[turn][:-1] for v in own], axis=0)
    return later


def _packed(names: list[tuple[int, int]], found: list[dict[str, np.ndarray]], buckets: int) -> pa.RecordBatch:
    all_of = {c: np.concatenate([f[c] for f in found]) for c in FIELDS}
    ids, hashes = (np.array(x, dtype=np.int64) for x in zip(*names))
    bucket = (all_of["anchor"] % np.uint64(buckets)).astype(np.int64)
    bucket[_later_equals(all_of, ids, hashes)] = buckets
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(buckets + 2))
    numbers, payloads = [], []
    for b in [*range(buckets), buckets]:
        mine = order[cuts[b] : cuts[b + 1]]
        if len(mine):
            own, place = np.unique(all_of["owner"][mine], return_inverse=True)
            columns = [(place if c == "owner" else all_of[c][mine]).astype(kind).tobytes() for c, kind in FIELDS.items()]
            numbers.append(b if b < buckets else -1 - int(hashes[0]) % buckets)
            payloads.append(b"".join([np.array([len(own), len(mine)], dtype="<u4").tobytes(), ids[own].tobytes(), hashes[own].tobytes(), *columns]))
    return pa.RecordBatch.from_pydict({"bucket": pa.array(numbers, pa.int32()), "payload": pa.array(payloads, pa.binary())})


def _unpacked(payload: pa.Buffer) -> dict[str, np.ndarray]:
    n, m = np.frombuffer(payload, dtype="<u4", count=2).tolist()
    ids, hashes = np.frombuffer(payload, dtype=np.int64, count=2 * n, offset=8).reshape(2, n)
    at, columns = 8 + 16 * n, {}
    for c, kind in FIELDS.items():
        columns[c] = np.frombuffer(payload, dtype=kind, count=m, offset=at)
        at += m * np.dtype(kind).itemsize
    owner = columns.pop("owner")
    return {**columns, "id": ids[owner], "h": hashes[owner]}


def matched(dealt: DataFrame) -> DataFrame:
    """(id, h, start, end, anchor, hot): bytes that repeat, without an anchor; and segments to be compared, with theirs.

    Anchors with more than ``SHARD_BYTES`` of segments are hot.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = []
        for batch in batches:
            for bucket, value in zip(batch.column("bucket").to_pylist(), batch.column("payload")):
                part = _unpacked(value.as_buffer())
                if bucket >= 0:
                    parts.append(part)
                    continue
                start, none = part["start"].astype(np.int64), len(part["start"])
                yield pa.RecordBatch.from_pydict({
                    "id": pa.array(part["id"]), "h": pa.array(part["h"]), "start": pa.array(start),
                    "end": pa.array(start + part["windows"] + (WINDOW - 1)), "anchor": pa.nulls(none, pa.int64()), "hot": pa.array([False] * none)})
        if not parts:
            return
        anchor = np.concatenate([p["anchor"] for p in parts])
        order = np.argsort(anchor)
        same = anchor[order][1:] == anchor[order][:-1]
        shared = np.zeros(len(order), dtype=bool)
        shared[1:] |= same
        shared[:-1] |= same
        kept = order[shared]
        x = {}
        for c in list(parts[0]):
            x[c] = np.concatenate([p.pop(c) for p in parts])[kept]
        order = np.lexsort((x["start"], x["h"], x["id"], x["whole"], x["windows"], x["lead"], x["anchor"]))
        x = {c: v[order] for c, v in x.items()}
        if not len(order):
            return
        # One document that several tasks gave (equal rows) counts once.
        new = np.zeros(len(order), dtype=bool)
        new[:1] = True
        for v in x.values():
            new[1:] |= v[1:] != v[:-1]
        x = {c: v[new] for c, v in x.items()}
        new_anchor = np.diff(x["anchor"], prepend=x["anchor"][:1] + np.uint64(1)) != 0
        # Equal segments are one string; the earliest of them comes first.
        first = new_anchor.copy()
        for c in ("lead", "windows", "whole"):
            first |= np.diff(x[c], prepend=x[c][:1]) != 0
        group = np.cumsum(new_anchor) - 1
        several = (np.bincount(group, weights=first) > 1)[group]
        end = x["start"].astype(np.int64) + x["windows"] + (WINDOW - 1)
        hot = (np.bincount(group, weights=first * (x["windows"] + (WINDOW - 1.0))) > SHARD_BYTES)[group]
        chosen = ~first | several
        wanted = (first & several)[chosen]
        for a in range(0, len(wanted), 100_000):
            part = np.flatnonzero(chosen)[a : a + 100_000]
            yield pa.RecordBatch.from_pydict({
                "id": pa.array(x["id"][part]), "h": pa.array(x["h"][part]), "start": pa.array(x["start"][part].astype(np.int64)),
                "end": pa.array(end[part]), "anchor": pa.array(x["anchor"][part].view(np.int64), mask=~wanted[a : a + 100_000]),
                "hot": pa.array(hot[part] & wanted[a : a + 100_000])})

    return map_batches(dealt, run, "id long, h long, start long, end long, anchor long, hot boolean")


def fetched(involved: DataFrame) -> DataFrame:
    """The text of each segment that the arrays need."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for id_, h, text, wanted in zip(batch.column("id").to_pylist(), batch.column("h").to_pylist(),
                                            batch.column("text").cast(pa.large_binary()), batch.column("wanted").to_pylist()):
                raw = text.as_py()
                if wanted:
                    yield pa.RecordBatch.from_pydict({
                        "anchor": pa.array([w["anchor"] for w in wanted], pa.int64()),
                        "id": pa.array([id_] * len(wanted), pa.int64()), "h": pa.array([h] * len(wanted), pa.int64()),
                        "start": pa.array([w["start"] for w in wanted], pa.int64()),
                        "segment": pa.array([raw[w["start"] : w["end"]] for w in wanted], pa.binary())})

    return map_batches(involved, run, "anchor long, id long, h long, start long, segment binary")


def hot_windows(involved: DataFrame) -> DataFrame:
    """(digest, id, h, start) of each window of the segments that are wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for id_, h, text, wanted in zip(batch.column("id").to_pylist(), batch.column("h").to_pylist(),
                                            batch.column("text").cast(pa.large_binary()), batch.column("wanted").to_pylist()):
                raw = text.as_py()
                places = [at for w in wanted for at in range(w["start"], w["end"] - WINDOW + 1)]
                for a in range(0, len(places), 100_000):
                    some = places[a : a + 100_000]
                    yield pa.RecordBatch.from_pydict({
                        "digest": pa.array([hashlib.blake2b(raw[at : at + WINDOW], digest_size=DIGEST_BYTES).digest() for at in some], pa.binary()),
                        "id": pa.array([id_] * len(some), pa.int64()), "h": pa.array([h] * len(some), pa.int64()), "start": pa.array(some, pa.int64())})

    return map_batches(involved, run, "digest binary, id long, h long, start long")


def window_repeats(windows: DataFrame) -> DataFrame:
    """(id, h, start, end) of the windows that have an earlier equal.

    Each task first reduces its windows to the earliest of each digest, so one that very many documents have is
    one row per task there.
    """
    place = F.struct("id", "h", "start")
    earliest = stored(windows.groupBy("digest").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"))
                      .filter("n > 1").select("digest", "first"), "earliest")
    return windows.join(earliest, "digest").filter(place > F.col("first")).select(
        "id", "h", "start", (F.col("start") + WINDOW).alias("end"))


def shard_repeats(ids: np.ndarray, hashes: np.ndarray, starts: np.ndarray, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a shard of segments: number of the segment, first and last byte (exclusive) of what repeats, by its suffix array."""
    sizes = np.array([len(t) for t in texts])
    raw = np.frombuffer(b"\0".join(texts) + bytes(WINDOW + 8), dtype=np.uint8)
    n = int(sizes.sum()) + len(texts)
    base = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    symbols = raw[:n].astype(np.int64) + 2
    symbols[base + sizes] = 1  # between segments
    array = suffix_array(np.append(symbols, 0), 258)
    counts = sizes - WINDOW + 1
    places = np.arange(counts.sum()) + np.repeat(base - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts)
    of = np.repeat(np.arange(len(texts)), counts)
    is_window = np.zeros(n + 1, dtype=bool)
    is_window[places] = True
    before, common = common_prefixes(raw, array, places, WINDOW)
    linked = np.zeros(n + 1, dtype=bool)
    linked[places] = (common >= WINDOW) & is_window[before]
    # Runs of equal windows in the array; of each the earliest place stays.
    order = array[is_window[array]]
    run = np.flatnonzero(~linked[order])
    documents = np.lexsort((hashes, ids))
    changed = (np.diff(ids[documents], prepend=0) != 0) | (np.diff(hashes[documents], prepend=0) != 0)
    rank = np.empty(len(texts), dtype=np.int64)
    rank[documents] = np.cumsum(changed)
    age = np.zeros(n + 1, dtype=np.int64)
    age[places] = rank[of] << 32 | starts[of] + places - base[of]
    ages = age[order]
    earliest = np.repeat(np.minimum.reduceat(ages, run), np.diff(run, append=len(order)))
    repeats = np.zeros(n + 1, dtype=bool)
    repeats[order] = ages != earliest
    hits = np.flatnonzero(repeats[places])
    breaks = np.flatnonzero((np.diff(places[hits], prepend=-2) != 1) | (np.diff(of[hits], prepend=-1) != 0))
    if not len(hits):
        return (np.zeros(0, dtype=np.int64),) * 3
    left, right = hits[breaks], hits[np.append(breaks[1:], len(hits)) - 1]
    owner = of[left]
    return owner, starts[owner] + places[left] - base[owner], starts[owner] + places[right] - base[owner] + WINDOW


def array_repeats(parts: DataFrame) -> DataFrame:
    """(id, h, start, end) of the bytes that repeat, from the suffix arrays of shards of whole anchors."""
    tasks = 2 * int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = parts.repartition(tasks, "anchor").sortWithinPartitions("anchor")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, int, bytes]] = []
        size, last = 0, None

        def flush() -> Iterator[pa.RecordBatch]:
            ids, hashes, starts = (np.array([h[i] for h in held], dtype=np.int64) for i in range(3))
            owner, start, end = shard_repeats(ids, hashes, starts, [h[3] for h in held])
            yield pa.RecordBatch.from_pydict({"id": pa.array(ids[owner]), "h": pa.array(hashes[owner]), "start": pa.array(start), "end": pa.array(end)})

        for batch in batches:
            for anchor, id_, h, start, segment in zip(*(batch.column(c).to_pylist() for c in ("anchor", "id", "h", "start", "segment"))):
                if anchor != last and size >= SHARD_BYTES:
                    yield from flush()
                    held, size = [], 0
                last = anchor
                held.append((id_, h, start, segment))
                size += len(segment)
        if held:
            yield from flush()

    return map_batches(dealt, run, "id long, h long, start long, end long")


def merged(removed: list[dict], more: list[dict] | None) -> list[tuple[int, int]]:
    """Overlapping and touching spans as maximal ones."""
    spans: list[tuple[int, int]] = []
    for start, end in sorted((s["start"], s["end"]) for s in [*removed, *(more or [])]):
        if spans and start <= spans[-1][1]:
            spans[-1] = spans[-1][0], max(spans[-1][1], end)
        else:
            spans.append((start, end))
    return spans


def cut_texts(involved: DataFrame, more: DataFrame, with_text: bool) -> DataFrame:
    """(id, h, spans, kept_sha256, kept) of every document of which some bytes may repeat; ``kept`` only if asked for."""
    extra = more.groupBy("id", "h").agg(F.collect_list(F.struct("start", "end")).alias("more"))
    rows = involved.select("id", "h", "text", "removed").join(extra, ["id", "h"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, digests, kept = [], [], []
            for text, removed, found in zip(batch.column("text").cast(pa.large_binary()), batch.column("removed").to_pylist(), batch.column("more").to_pylist()):
                raw = text.as_py()
                own = merged(removed, found)
                edges = [0, *[e for s in own for e in s], len(raw)]
                rest = b"".join([raw[a:b] for a, b in zip(edges[::2], edges[1::2])])
                spans.append([{"start": a, "end": b} for a, b in own])
                digests.append(hashlib.sha256(rest).hexdigest())
                kept.append(rest if with_text else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("h"), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                 pa.array(digests, pa.string()), pa.array(kept, pa.binary())], names=["id", "h", "spans", "kept_sha256", "kept"])

    return map_batches(rows, run, "id long, h long, spans array<struct<start: long, end: long>>, kept_sha256 string, kept binary")


def repeated_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, spans (start and end of each maximal removed run), kept_sha256 and kept of every row.

    A byte is removed when a string of ``WINDOW`` bytes over it also starts earlier: in a document with a smaller
    id, or earlier in the same one; strings are judged on the input. A null text is empty. Texts shorter than
    ``WINDOW`` bytes stay. Documents without an id come last. Rows that agree in id and text are one document and
    get the same result; rows of one id with different texts are ordered by a hash of the text. An empty table
    gives an empty table; other columns are not read. ``kept`` holds the remaining bytes if ``with_text``
    is set, and is null otherwise or where the whole text stays.
    """
    empty = hashlib.sha256(b"").hexdigest()
    source = keyed(docs, doc_id, text)
    facts = stored(docs.select(F.col(doc_id).cast("long").alias("doc_id"), whole_text(text).alias("text")).select(
        "doc_id", F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), F.xxhash64("text").alias("h"), F.octet_length("text").cast("long").alias("n_bytes"),
        F.sha2(F.col("text").cast("binary"), 256).alias("sha")), "facts")
    copies = stored(facts.filter(F.col("n_bytes") >= WINDOW).groupBy("sha").agg(F.min("id").alias("first_id"), F.max("id").alias("last_id"))
                    .filter("first_id < last_id").select("sha", "first_id"), "copies")
    matches = stored(matched(dealt_segments(source)), "matches")
    span, want = F.struct("start", "end"), F.struct("start", "end", "anchor")
    per_document = matches.groupBy("id", "h").agg(
        F.collect_list(F.when(F.col("anchor").isNull(), span)).alias("removed"),
        F.collect_list(F.when(F.col("anchor").isNotNull() & ~F.col("hot"), want)).alias("wanted"),
        F.collect_list(F.when(F.col("hot"), want)).alias("hot"))
    involved = stored(source.join(per_document, ["id", "h"]), "involved")
    more = stored(array_repeats(fetched(involved.filter(F.size("wanted") > 0))), "repeats")
    if matches.filter("hot").limit(1).count():
        # Equal rows of a document give their windows once.
        chosen = involved.filter(F.size("hot") > 0).drop("wanted").withColumnRenamed("hot", "wanted").dropDuplicates(["id", "h"])
        more = more.unionByName(stored(window_repeats(stored(hot_windows(chosen), "hot-windows")), "hot-repeats"))
    results = cut_texts(involved, more, with_text).dropDuplicates(["id", "h"])
    rows = facts.join(copies, "sha", "left").join(results, ["id", "h"], "left")
    copy = F.coalesce(F.col("first_id") < F.col("id"), F.lit(False))
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end")))
    none = F.array().cast("array<struct<start: bigint, end: bigint>>")
    return rows.select(
        "doc_id", "n_bytes", F.when(copy, whole).otherwise(F.coalesce("spans", none)).alias("spans"),
        F.when(copy, F.lit(empty)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        F.when(copy & F.lit(with_text), F.lit(b"")).otherwise(F.col("kept")).alias("kept"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is removed from every document, in numbers and as a digest of the rest."""
    found = repeated_spans(table(prepare(spark), sf_dir, "documents"))
    return found.select(
        "doc_id", "n_bytes", F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), "kept_sha256")
