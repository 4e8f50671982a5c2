"""Near-duplicate documents: an exact Jaccard join of word-shingle sets through PartEnum signatures.

1. Every text becomes its set of five-word shingles. Equal sets are one node, whatever the number of copies.
2. Each task gives the signatures of the nodes it meets, once per node, as packed arrays that are dealt out by signature.
   Signatures that one node alone has are dropped there. Near copies share many signatures: groups of the same nodes are
   one group, whatever the number of their signatures.
3. In each signature's group the smallest node is the pivot, and the others are compared with it. That settles
   most groups of near copies without their pairs.
4. Where a group's members lie in several components, they are compared in blocks by bitmaps, which can only rule out pairs
   that are too far apart. In a few rounds each component gives its nearest pair with another one; then all pairs
   that are left between components are compared. No link between components is lost.
5. Links between nodes become components by spreading the smallest node; the smallest id of a component is its name.

Every pair is confirmed on the whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from shoplight.llm.common import free_name, map_batches, mix, table, text_slices, whole_text
from shoplight.llm.signatures import distance, shingle_sets, signatures, similar
from shoplight.session import prepare, stored

# A bitmap has twice as many bits as its set has shingles, between these bounds.
LEAST_BITS, MOST_BITS = 64, 1 << 16
# Bytes of text whose signatures are packed together, and nodes after which a packing is closed.
PACK_BYTES, PACK_NODES = 4 << 20, 40_000
# Members of one block in step 4, and rounds in which a component gives one pair only.
BLOCK, ROUNDS = 512, 3
# Bits of a signature that are packed; those of its bucket come on top. Two signatures taken for one only cost a comparison.
PACKED_BITS = 48


def node_of(values: np.ndarray) -> tuple[int, int]:
    """Two 64-bit hashes of a set, as signed numbers: the node, and a check that no two sets share one."""
    first = mix(values.sum(dtype=np.uint64, keepdims=True) + np.uint64(len(values)))
    second = mix(mix(values ^ np.uint64(0x2545F4914F6CDD1D)).sum(dtype=np.uint64, keepdims=True))
    return int(first.view(np.int64)[0]), int(second.view(np.int64)[0])


def bitmap_of(values: np.ndarray) -> bytes:
    """The parity of each bin's values. Two bitmaps differ in no more bits than their sets do in values."""
    bits = min(max(LEAST_BITS, 1 << int(2 * len(values) - 1).bit_length()), MOST_BITS)
    counts = np.bincount((values & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits(counts & 1, bitorder="little").tobytes()


def folded(bitmaps: list[bytes]) -> np.ndarray:
    """Bitmaps as rows of 64-bit words, all folded to the shortest of them."""
    least = min(map(len, bitmaps))
    rows = np.empty((len(bitmaps), least // 8), dtype=np.uint64)
    for i, raw in enumerate(bitmaps):
        rows[i] = np.bitwise_xor.reduce(np.frombuffer(raw, dtype=np.uint64).reshape(-1, least // 8), axis=0)
    return rows


def set_rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Each row's id, digest of its text, set size, node, check and, for the first row of a node in a task, bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            at = 0
            for keys, texts in text_slices(batch, "doc_id", "text", 1 << 20):
                rows = []
                for key, values in zip(keys, shingle_sets(texts)):
                    if not len(values):
                        rows.append((key, 0, None, None, None))
                        continue
                    node, check = node_of(values)
                    rows.append((key, len(values), node, check, None if node in seen else bitmap_of(values)))
                    seen.add(node)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(batch.schema.get_field_index("digest")).slice(at, len(rows)),
                     *[pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))]],
                    names=["digest", "doc_id", "n_shingles", "node", "check", "bitmap"])
                at += len(rows)

    chosen = _chosen(docs, doc_id, text).withColumn("digest", text_digest("text"))
    return map_batches(chosen, run, "digest binary, doc_id long, n_shingles long, node long, check long, bitmap binary")


def text_digest(text: str) -> Column:
    """Sixteen bytes that tell texts apart; null is read as empty."""
    return F.unhex(F.md5(whole_text(text)))


def _chosen(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))


def nodes_of(sets: DataFrame) -> DataFrame:
    """One row per distinct set: node, its smallest doc_id, size and bitmap."""
    clash = F.raise_error(F.lit("two different sets share a 64-bit hash"))
    return (sets.filter("node IS NOT NULL AND doc_id IS NOT NULL").groupBy("node")
            .agg(F.min("doc_id").alias("rep"), F.max("n_shingles").alias("size"), F.max("bitmap").alias("bitmap"),
                 F.min("check").alias("low"), F.max("check").alias("high"))
            .select("node", F.when(F.col("low") != F.col("high"), clash.cast("long")).otherwise(F.col("rep")).alias("rep"), "size", "bitmap"))


def groups(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(signature, node, pivot) of every group of two nodes or more that share a signature, under one name for all signatures of the group."""
    spark = docs.sparkSession
    tasks = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = 2 * tasks

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        nodes, found, owners, size = [], [], [], 0
        for batch in batches:
            for keys, texts in text_slices(batch, "doc_id", "text", 1 << 20):
                fresh, fresh_nodes = [], []
                for key, values in zip(keys, shingle_sets(texts)):
                    if key is not None and len(values) and (node := node_of(values)[0]) not in seen:
                        seen.add(node)
                        fresh.append(values)
                        fresh_nodes.append(node)
                signature, owner = signatures(fresh)
                found.append(signature)
                owners.append(owner + len(nodes))
                nodes += fresh_nodes
                size += sum(map(len, texts))
                if size >= PACK_BYTES or len(nodes) >= PACK_NODES:
                    yield from packed(nodes, found, owners)
                    nodes, found, owners, size = [], [], [], 0
        yield from packed(nodes, found, owners)

    def packed(nodes: list[int], found: list[np.ndarray], owners: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if not nodes:
            return
        signature, owner = np.concatenate(found), np.concatenate(owners)
        bucket = ((signature >> np.uint64(PACKED_BITS)) * np.uint64(buckets) >> np.uint64(64 - PACKED_BITS)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        signature, owner, bucket = signature[order], owner[order], bucket[order]
        low = signature.view(np.uint8).reshape(-1, 8)[:, : PACKED_BITS // 8]  # little-endian
        cuts = np.searchsorted(bucket, np.arange(buckets + 1))
        names, every = [], np.array(nodes, dtype=np.int64)
        payloads = []
        for b in range(buckets):
            mine = owner[cuts[b] : cuts[b + 1]]
            if len(mine):
                own, place = np.unique(mine, return_inverse=True)
                names.append(b)
                payloads.append(np.array([len(own), len(mine)], dtype="<u4").tobytes() + every[own].tobytes()
                                + low[cuts[b] : cuts[b + 1]].tobytes() + place.astype("<u4" if len(own) > 65_535 else "<u2").tobytes())
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(names, pa.int32()), "payload": pa.array(payloads, pa.binary())})

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, nodes = [], []
        width = PACKED_BITS // 8
        for batch in batches:
            for bucket, value in zip(batch.column("bucket").to_pylist(), batch.column("payload")):
                raw = value.as_buffer()
                n, m = np.frombuffer(raw, dtype="<u4", count=2).tolist()
                every = np.frombuffer(raw, dtype=np.int64, count=n, offset=8)
                full = np.zeros((m, 8), dtype=np.uint8)
                full[:, :width] = np.frombuffer(raw, dtype=np.uint8, count=width * m, offset=8 + 8 * n).reshape(m, width)
                found.append(full.view(np.uint64).ravel() | np.uint64(bucket % (1 << (64 - PACKED_BITS)) << PACKED_BITS))
                nodes.append(every[np.frombuffer(raw, dtype="<u4" if n > 65_535 else "<u2", count=m, offset=8 + 8 * n + width * m)])
        if not found:
            return
        signature, node = np.concatenate(found), np.concatenate(nodes)
        del found, nodes
        order = np.argsort(signature)
        signature, node = signature[order], node[order]
        shared = np.zeros(len(signature), dtype=bool)
        same = signature[1:] == signature[:-1]
        shared[1:] |= same
        shared[:-1] |= same
        signature, node = signature[shared], node[shared]
        # A node that several tasks gave counts once.
        order = np.lexsort((node, signature))
        signature, node = signature[order], node[order]
        new = np.ones(len(node), dtype=bool)
        new[1:] = (signature[1:] != signature[:-1]) | (node[1:] != node[:-1])
        signature, node = signature[new], node[new]
        starts = np.flatnonzero(np.r_[True, signature[1:] != signature[:-1]]) if len(node) else np.zeros(0, dtype=np.int64)
        counts = np.diff(starts, append=len(node))
        keep = np.repeat(counts > 1, counts)
        signature, node = signature[keep], node[keep]
        counts = counts[counts > 1]
        if not len(counts):
            return
        # Groups of the same nodes are one. They are known by two sums over their nodes, one of which becomes their name.
        begin = np.cumsum(counts) - counts
        name, other = (np.add.reduceat(mix(node.view(np.uint64) + np.uint64(c)), begin) for c in (1, 2))
        _, one_of = np.unique(np.stack([name, other], axis=1), axis=0, return_index=True)
        chosen = np.zeros(len(counts), dtype=bool)
        chosen[one_of] = True
        signature, node = np.repeat(name, counts)[np.repeat(chosen, counts)], node[np.repeat(chosen, counts)]
        counts = counts[chosen]
        # The pivot is the smallest node: nodes that share many groups then mostly have one pivot in all of them.
        pivot = np.repeat(node[np.concatenate([[0], np.cumsum(counts)[:-1]])], counts)
        for a in range(0, len(node), 100_000):
            part = slice(a, a + 100_000)
            yield pa.RecordBatch.from_pydict({
                "signature": pa.array(signature[part].view(np.int64)), "node": pa.array(node[part]), "pivot": pa.array(pivot[part])})

    dealt = map_batches(_chosen(docs, doc_id, text), pack, "bucket int, payload binary").repartition(tasks, "bucket")
    # Several tasks may give one group.
    return map_batches(dealt, unpack, "signature long, node long, pivot long").distinct()


def near_enough(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Those pairs (a, b) of nodes that their bitmaps do not rule out."""
    side = lambda name: nodes.select(
        F.col("node").alias(name), F.col("size").alias(f"{name}_size"), F.col("bitmap").alias(f"{name}_map"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column("a_size").to_numpy(), batch.column("b_size").to_numpy()
            ok = np.zeros(batch.num_rows, dtype=bool)
            for i, (x, y, most) in enumerate(zip(batch.column("a_map"), batch.column("b_map"), distance(a, b))):
                rows = folded([x.as_py(), y.as_py()])
                ok[i] = np.bitwise_count(rows[0] ^ rows[1]).sum() <= most
            yield batch.select(["a", "b"]).filter(pa.array(ok))

    return map_batches(pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "a_size", "b_size", "a_map", "b_map"), run, "a long, b long")


def confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b): the pairs of nodes whose whole texts are similar."""
    side = lambda name: texts.select(F.col("node").alias(name), F.col("text").alias(f"{name}_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int, np.ndarray] | None = None
        for batch in batches:
            links = []
            for a, b, x, y in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), batch.column("a_text"), batch.column("b_text")):
                # Rows of one node mostly come together.
                if last is None or last[0] != a:
                    last = a, shingle_sets([x.as_py().encode()])[0]
                other = shingle_sets([y.as_py().encode()])[0]
                if node_of(last[1])[0] == a and node_of(other)[0] == b and similar(last[1], other):
                    links.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], names=["a", "b"])

    both = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "a_text", "b_text")
    return map_batches(both, run, "a long, b long")


def counted(df: DataFrame, label: str, what: Column) -> tuple[DataFrame, int]:
    """``stored``, and how many rows meet a condition, which the write counts on its way."""
    seen = Observation()
    written = stored(df.observe(seen, F.count_if(what).alias("n")), label)
    return written, int(seen.get.get("n") or 0)


def components(links: DataFrame) -> DataFrame:
    """(id, label): the smallest id that each linked id reaches.

    In each turn every id takes the smallest label of its neighbours and then that label's own label, so
    distances halve. The tables of each turn are written to the shared folder.
    """
    edges = stored(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct(), "edges")
    labels = stored(edges.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("label")), "labels")
    while True:
        heard = (edges.join(labels, edges.b == labels.id).groupBy("a").agg(F.min("label").alias("heard")))
        nearer = labels.join(heard, labels.id == heard.a).select("id", "label", F.least("label", "heard").alias("next"))
        # Then the label's own label of the turn before.
        over = labels.select(F.col("id").alias("next"), F.col("label").alias("beyond"))
        new, changed = counted(nearer.join(over, "next", "left").select(
            "id", F.least("next", "beyond").alias("label"), (F.least("next", "beyond") < F.col("label")).alias("changed")), "labels", F.col("changed"))
        labels = new.select("id", "label")
        if not changed:
            return labels


def joined_components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``nodes`` with new labels, after links between nodes; the components so far are the ids of a smaller graph."""
    own = nodes.select("node", "label")
    side = lambda name: own.select(F.col("node").alias(name), F.col("label").alias(f"{name}_label"))
    between = links.join(side("a"), "a").join(side("b"), "b").select(F.col("a_label").alias("a"), F.col("b_label").alias("b"))
    labels = components(between).select(F.col("id").alias("label"), F.col("label").alias("joined"))
    return stored(nodes.join(labels, "label", "left").withColumn("label", F.coalesce("joined", "label")).drop("joined"), "nodes")


def open_groups(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """The members of groups whose nodes lie in several components, with the number of blocks of their group.

    Groups of two are settled, as their one pair was compared. A settled group stays settled.
    """
    label = nodes.select("node", "label")
    pivot = nodes.select(F.col("node").alias("pivot"), F.col("label").alias("pivot_label"))
    apart = members.select("signature", "node", "pivot").join(label, "node").join(pivot, "pivot")
    counts = (apart.groupBy("signature").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") != F.col("pivot_label")).alias("apart"))
              .filter("apart > 0 AND n > 2").select("signature", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")))
    return stored(members.select("signature", "node", "pivot").join(counts, "signature"), "members")


def cross_pairs(members: DataFrame, nodes: DataFrame, best: bool) -> DataFrame:
    """Pairs (a, b) of open groups between components that the bitmaps do not rule out and that hold no pivot.

    With ``best``, of each component in a block only the pair with the nearest bitmaps.
    """
    rows = members.join(nodes.select("node", "label", "size", "bitmap"), "node")
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = (rows.withColumn("block", block).withColumn("with", F.explode(F.expr("sequence(0, blocks - 1)")))
             .select("signature", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "block", "node", "label",
                     (F.col("node") == F.col("pivot")).alias("is_pivot"), "size", "bitmap")
             .repartition("signature", "i", "j").sortWithinPartitions("signature", "i", "j", "node"))

    def pairs_of(chunk: dict[str, list]) -> tuple[np.ndarray, np.ndarray]:
        node, label, size, block = (np.array(chunk[c]) for c in ("node", "label", "size", "block"))
        pivot = np.array(chunk["is_pivot"])
        maps = folded(chunk["bitmap"])
        found_a, found_b, gaps = [], [], []
        for k in range(len(node) - 1):
            rest = slice(k + 1, None)
            ok = (label[rest] != label[k]) & ~pivot[rest] & (not pivot[k])
            if chunk["i"] != chunk["j"]:
                ok &= block[rest] != block[k]
            gap = np.bitwise_count(maps[rest] ^ maps[k]).sum(axis=1)
            hits = np.flatnonzero(ok & (gap <= distance(size[rest], size[k])))
            found_a += [k] * len(hits)
            found_b += (hits + k + 1).tolist()
            gaps += gap[hits].tolist()
        a, b = np.array(found_a, dtype=np.int64), np.array(found_b, dtype=np.int64)
        if best and len(a):
            # Each pair counts for both its components; of each component the nearest stays.
            sides, twice = np.concatenate([label[a], label[b]]), np.tile(np.arange(len(a)), 2)
            order = np.lexsort((twice, np.tile(np.array(gaps), 2), sides))
            first = np.flatnonzero(np.diff(sides[order], prepend=sides[order][:1] - 1) != 0)
            kept = np.unique(twice[order[first]])
            a, b = a[kept], b[kept]
        return np.minimum(node[a], node[b]), np.maximum(node[a], node[b])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, chunk = None, {}
        names = ("node", "label", "size", "block", "is_pivot", "bitmap")

        def flush() -> Iterator[pa.RecordBatch]:
            if key is not None and len(chunk["node"]) > 1:
                a, b = pairs_of({**chunk, "i": key[1], "j": key[2]})
                if len(a):
                    yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

        for batch in batches:
            marks = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("signature", "i", "j")], axis=1)
            values = {c: batch.column(c).to_pylist() for c in names}
            ends = np.flatnonzero(np.any(np.diff(marks, axis=0) != 0, axis=1)) + 1
            for start, end in zip([0, *ends], [*ends, batch.num_rows]):
                mark = tuple(marks[start].tolist())
                if mark != key:
                    yield from flush()
                    key, chunk = mark, {c: [] for c in names}
                for c in names:
                    chunk[c] += values[c][start:end]
        yield from flush()

    return map_batches(dealt, run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id of every row.

    Words are runs of other bytes than 0x20 and 0x09 to 0x0D, with A-Z lowered. A null or empty text
    or one without words has the empty set, is linked with nothing and is its own component. A
    row without an id takes no part in links, and its component is null. Repeated rows are equal
    sets and so linked. An empty table gives an empty table; other columns are not read.
    """
    return _components_of_rows(docs, doc_id, text).select(
        "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("first.rep", "doc_id")).alias("component_id"))


def _components_of_rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """The rows of ``set_rows`` with ``first``: the smallest id of their component and the node that has it."""
    sets = stored(set_rows(docs, doc_id, text), "sets")
    nodes = stored(nodes_of(sets), "nodes")
    members = stored(groups(docs, doc_id, text), "groups")
    # The texts of nodes that share a signature with another.
    wanted = nodes.join(members.select("node").distinct(), "node").select("node", "rep")
    chosen = sets.select("doc_id", "digest", "node").join(wanted, "node").filter("doc_id = rep").groupBy("node").agg(
        F.min("doc_id").alias("doc_id"), F.min("digest").alias("digest"))
    source = _chosen(docs, doc_id, text).withColumn("digest", text_digest("text"))
    texts = stored(source.join(chosen, ["doc_id", "digest"]).groupBy("doc_id", "digest", "node").agg(
        F.any_value("text").alias("text")), "texts")
    pairs = stored(members.filter("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct(), "pairs")
    links = stored(confirmed(near_enough(pairs, nodes), texts), "links")
    nodes = joined_components(nodes.withColumn("label", F.col("node")), links)
    for turn in range(ROUNDS + 1):
        members = open_groups(members, nodes)
        pairs, found = counted(cross_pairs(members, nodes, best=turn < ROUNDS), "pairs", F.lit(True))
        if not found:
            break
        nodes = joined_components(nodes, stored(confirmed(pairs, texts), "links"))
    firsts = nodes.groupBy("label").agg(F.min(F.struct("rep", "node")).alias("first"))
    own = nodes.select("node", "label").join(firsts, "label").select("node", "first")
    return sets.join(own, "node", "left")


def without_near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: those with the smallest id of their component and, where an id comes with several
    texts, the one set of them that the component is known by; and those without an id. Repeated rows stay or go together.
    """
    found = _components_of_rows(docs, doc_id, text)
    gone, mark = free_name(docs, "gone_id"), free_name(docs, "gone_digest")
    dropped = stored(found.filter("doc_id IS NOT NULL AND (first.rep <> doc_id OR first.node <> node)").select(
        F.col("doc_id").alias(gone), F.col("digest").alias(mark)).distinct(), "near-copies")
    return docs.join(dropped, (F.col(doc_id) == F.col(gone)) & (text_digest(text) == F.col(mark)), "left_anti")


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of every document."""
    return near_duplicates(table(prepare(spark), sf_dir, "documents"))
