"""Prefix trie of conversations by collapsing whole sequences first.

1. Every conversation is rebuilt: the opening of its hundred's first conversation, then its own turns. A turn
   is known by a digest of role and text; the texts themselves do not travel.
2. A prefix is known by its length and the sums of its turns' hashes, each bound to its place. Sums
   of chunks add up, so no conversation, however long, is read by one task.
3. Identical conversations are collapsed into one sequence with its weight, its smallest member and
   the digest of the list of its members. Only the sequences go on.
4. Sequences that are proper prefixes of others go out by an anti-join; what is left are the leaves.
5. The prefixes of the sequences are aggregated with their weights. Of the members of a node the
   smallest owns it, and what a sequence owns is the end of its path. So sums over a subtree are sums
   over the sequences that pass through its top, and no pair of a node and its ancestor is built.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shoplight.llm.common import map_batches, table
from shoplight.operators.sequences import in_chunks, neighbours_in_chunks
from shoplight.session import prepare, stored

# Conversations that share one opening, and the most turns of an opening plus one.
SHARING, OPENINGS = 100, 6
# Bytes of one piece of a list of members.
PIECE_BYTES = 16 << 10
LANES = ["lane1", "lane2", "lane3", "lane4"]
KEY = ["depth", "key1", "key2"]
NO_ENDS = hashlib.sha256(b"").hexdigest()


def digest(role: Column, text: Column) -> Column:
    """Sixteen bytes that tell turns apart."""
    return F.unhex(F.md5(F.concat(F.md5(role), F.md5(text))))


def numbered_turns(conversations: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv_id, digest, chars, place, _chunk) of every turn of a conversation, in chunks of the whole order."""
    said = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text)]
    turns = conversations.filter(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).alias("turn"), digest(*said).alias("digest"),
        F.char_length(said[1]).cast("long").alias("chars"), F.monotonically_increasing_id().alias("row"))
    order = ["turn", "digest", "row"]
    found = neighbours_in_chunks(in_chunks(turns, ["conv_id", *order], "turns"), ["conv_id"], order, [], [], "place")
    return stored(found.select("conv_id", "digest", "chars", "place", "_chunk"), "numbered-turns")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The conversations, and the turns of the rebuilt ones: (conv_id, _chunk, depth, digest, chars).

    A conversation c takes the first h turns of conversation c - c % 100, h being crc32 of its decimal id
    modulo 6, and its own turns after the first h.
    """
    heads = (turns.filter(F.col("place") < OPENINGS).groupBy(F.col("conv_id").alias("head"))
             .agg(F.sort_array(F.collect_list(F.struct("place", "digest", "chars"))).alias("opening")))
    own = turns.groupBy("conv_id").agg(F.min("_chunk").alias("_chunk")).withColumns({
        "head": F.col("conv_id") - F.col("conv_id") % SHARING,
        "taken": (F.crc32(F.col("conv_id").cast("string").cast("binary")) % OPENINGS).cast("int")})
    known = stored(own.join(heads, "head", "left").select(
        "conv_id", "_chunk", "taken", F.expr("slice(coalesce(opening, array()), 1, taken)").alias("opening")), "openings")
    opened = known.select("conv_id", "_chunk", F.explode("opening").alias("t")).select(
        "conv_id", "_chunk", F.col("t.place").alias("depth"), "t.digest", "t.chars")
    kept = turns.join(known.select("conv_id", "taken", F.size("opening").alias("got")), "conv_id").filter("place > taken").select(
        "conv_id", "_chunk", (F.col("place") - F.col("taken") + F.col("got")).alias("depth"), "digest", "chars")
    return known.select("conv_id"), opened.unionByName(kept)


def key_of(sums: list[Column]) -> list[Column]:
    """Two 64-bit words of four sums of 32-bit hashes."""
    low = [s.bitwiseAND(F.lit(0xFFFFFFFF)) for s in sums]
    return [low[0].bitwiseOR(F.shiftleft(low[1], 32)), low[2].bitwiseOR(F.shiftleft(low[3], 32))]


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, key1, key2, parent1, parent2, chars, upto) of every prefix of one turn or more.

    ``upto`` is the code points of all its turns. Sums run inside chunks; a conversation in several
    chunks gets the sums of its chunks before, one row per chunk.
    """
    first, second = F.xxhash64("digest", "depth"), F.xxhash64("depth", "digest", F.lit(1))
    halves = [F.shiftrightunsigned(first, 32), first.bitwiseAND(F.lit(0xFFFFFFFF)),
              F.shiftrightunsigned(second, 32), second.bitwiseAND(F.lit(0xFFFFFFFF))]
    rows = turns.withColumns(dict(zip(LANES, halves)))
    summed = [*LANES, "chars"]
    ahead = Window.partitionBy("conv_id").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = (rows.groupBy("conv_id", "_chunk").agg(*[F.sum(c).alias(c) for c in summed])
              .withColumn("chunks", F.count("*").over(Window.partitionBy("conv_id")))
              .select("conv_id", "_chunk", "chunks", *[F.sum(c).over(ahead).alias(f"{c}_before") for c in summed])
              .filter("chunks > 1").drop("chunks"))
    inside = Window.partitionBy("conv_id", "_chunk").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    running = rows.select("conv_id", "_chunk", "depth", *summed, *[F.sum(c).over(inside).alias(f"{c}_inside") for c in summed])
    whole = {c: F.col(f"{c}_inside") + F.coalesce(F.col(f"{c}_before"), F.lit(0)) for c in summed}
    key, parent = key_of([whole[c] for c in LANES]), key_of([whole[c] - F.col(c) for c in LANES])
    return running.join(before, ["conv_id", "_chunk"], "left").select(
        "conv_id", F.col("depth").cast("long").alias("depth"), key[0].alias("key1"), key[1].alias("key2"),
        parent[0].alias("parent1"), parent[1].alias("parent2"), "chars", whole["chars"].alias("upto"))


def member_digests(members: DataFrame) -> DataFrame:
    """sha256 of the sorted decimal ids, joined by commas, of the members of each key.

    Ids are ordered by ranges, and each range packs its ids into pieces. The pieces of a key meet in one
    task, which reads them as a stream and holds one at a time: a digest has to see them in order.
    """
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        key, first, ids, size = None, 0, [], 0
        for batch in batches:
            marks = zip(*[batch.column(c).to_pylist() for c in (*KEY, "conv_id")])
            for *mark, conv in marks:
                if mark != key or size >= PIECE_BYTES:
                    if ids:
                        rows.append((*key, first, b",".join(ids)))
                    key, first, ids, size = mark, conv, [], 0
                ids.append(b"%d" % conv)
                size += len(ids[-1]) + 1
            if len(rows) >= 1000:
                yield piece_rows(rows)
                rows = []
        if ids:
            rows.append((*key, first, b",".join(ids)))
        if rows:
            yield piece_rows(rows)

    def piece_rows(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))],
            names=[*KEY, "first", "piece"])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            done = []
            for *mark, piece in zip(*[batch.column(c).to_pylist() for c in (*KEY, "piece")]):
                if mark == key:
                    state.update(b",")
                else:
                    if key is not None:
                        done.append((*key, state.hexdigest()))
                    key, state = mark, hashlib.sha256()
                state.update(piece)
            if done:
                yield digest_rows(done)
        if key is not None:
            yield digest_rows([(*key, state.hexdigest())])

    def digest_rows(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=[*KEY, "ends_sha256"])

    key = [F.col(c) for c in KEY]
    ranged = members.select(*KEY, "conv_id").repartitionByRange(parts, *key, F.col("conv_id")).sortWithinPartitions(*KEY, "conv_id")
    pieces = map_batches(ranged, pack, "depth long, key1 long, key2 long, first long, piece binary")
    return map_batches(pieces.repartition(parts, *key).sortWithinPartitions(*KEY, "first"), add_up,
                       "depth long, key1 long, key2 long, ends_sha256 string")


def trie(conversations: DataFrame, turns: DataFrame) -> DataFrame:
    """Every node of the trie of ``turns`` (conv_id, depth, digest, chars, _chunk) over ``conversations`` (conv_id).

    A conversation without turns is a member of the root. Without conversations there is no root.
    """
    root = {c: F.lit(0).cast("long") for c in ("depth", "key1", "key2", "upto")}
    paths = stored(prefixes(turns), "prefixes")
    ends = [*KEY, "upto"]
    members = stored(
        paths.select("conv_id", *ends).unionByName(conversations.withColumns(root).select("conv_id", *ends))
        .groupBy("conv_id").agg(F.max(F.struct(*ends)).alias("end")).select("conv_id", "end.*"), "members")
    # Collapse: one row per distinct sequence.
    sequences = stored(members.groupBy(*KEY).agg(
        F.count("*").alias("weight"), F.min("conv_id").alias("conv_id"), F.max("upto").alias("length")), "sequences")
    of_sequence = sequences.select("conv_id", "weight", "length", F.col("depth").alias("full"))
    steps = stored(
        paths.join(of_sequence, "conv_id").unionByName(
            of_sequence.withColumns({**root, "parent1": F.lit(0).cast("long"), "parent2": F.lit(0).cast("long"), "chars": F.lit(0).cast("long")})),
        "sequence-prefixes")
    inner = steps.filter("depth < full").select(*KEY).distinct()
    leaves = sequences.join(inner, KEY, "left_anti").select("conv_id", F.lit(1).cast("long").alias("leaf"))
    nodes = stored(steps.groupBy(*KEY).agg(
        F.min("conv_id").alias("conv_id"), F.sum("weight").alias("n_convs"), F.max("chars").alias("chars"), F.max("upto").alias("upto"),
        F.max("parent1").alias("parent1"), F.max("parent2").alias("parent2"), F.sum(F.col("weight") * F.col("length")).alias("all_chars")), "nodes")
    # What each sequence owns: the nodes whose smallest member it is, the end of its path.
    owned = stored(nodes.groupBy("conv_id").agg(
        F.sum("chars").alias("owned"), F.min("depth").alias("top"), F.min(F.col("upto") - F.col("chars")).alias("top_before")), "owned")
    shares = sequences.select("conv_id").join(owned, "conv_id", "left").join(leaves, "conv_id", "left").select(
        "conv_id", F.coalesce("owned", F.lit(0)).alias("owned"), F.coalesce("leaf", F.lit(0)).alias("leaf"))
    through = steps.select("conv_id", *KEY).join(shares, "conv_id").groupBy(*KEY).agg(
        F.sum("owned").alias("below"), F.sum("leaf").alias("n_leaves"))
    children = nodes.filter("depth > 0").groupBy(
        (F.col("depth") - 1).alias("depth"), F.col("parent1").alias("key1"), F.col("parent2").alias("key2")).agg(F.count("*").alias("n_children"))
    known = nodes.join(owned.drop("owned"), "conv_id")
    # Below the top of what a sequence owns, the parent's smallest member is the sequence itself.
    tops = known.filter("depth = top AND depth > 0").select(
        *KEY, (F.col("depth") - 1).alias("up"), "parent1", "parent2")
    above = nodes.select(F.col("depth").alias("up"), F.col("key1").alias("parent1"), F.col("key2").alias("parent2"), F.col("conv_id").alias("parent"))
    parents = tops.join(above, ["up", "parent1", "parent2"]).select(*KEY, "parent")
    start = F.col("upto") - F.col("chars")
    return (
        known.join(through, KEY).join(children, KEY, "left").join(parents, KEY, "left").join(member_digests(members), KEY, "left")
        .select(
            "conv_id", "depth",
            F.when(F.col("depth") > 0, F.coalesce("parent", "conv_id")).alias("parent_conv_id"),
            "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), "n_leaves",
            (F.col("all_chars") - F.col("n_convs") * start - F.col("below") + start - F.col("top_before")).alias("saved_tokens"),
            F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"))
    )


def conversation_trie(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The trie of rebuilt conversations, one row per node.

    Turns are ordered by ``turn``, null first; rows of one turn number by the digest of role and text, and equal
    rows stay as turns of their own. A null role or text counts as empty. Rows without a conversation id belong to
    no conversation. An empty table has no node, not even a root. Other columns are not read.
    """
    return trie(*rebuilt(numbered_turns(conversations, conv_id, turn, role, text)))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of the given conversations."""
    return conversation_trie(table(prepare(spark), sf_dir, "conversations"))


# crc32 by bits, as DuckDB has no such function.
_CRC = """list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda crc, byte: list_reduce(list_concat([xor(crc, byte)], list_transform(range(8), lambda i: 0::BIGINT)),
        lambda t, i: CASE WHEN t % 2 = 1 THEN xor(t // 2, 3988292384::BIGINT) ELSE t // 2 END))"""
SQL = f"""
WITH turns AS (
    SELECT conv_id AS c, md5(md5(coalesce(role, '')) || md5(coalesce(text, ''))) AS turn_key, length(coalesce(text, '')) AS chars,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(md5(coalesce(role, '')) || md5(coalesce(text, '')))) AS place
    FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT c, c - c % {SHARING} AS head, xor({_CRC}, 4294967295::BIGINT) % {OPENINGS} AS taken FROM (SELECT DISTINCT c FROM turns)),
parts AS (
    SELECT convs.c, 0 AS part, place, turn_key, chars FROM convs JOIN turns ON turns.c = head AND place <= taken
    UNION ALL SELECT convs.c, 1, place, turn_key, chars FROM convs JOIN turns ON turns.c = convs.c AND place > taken),
whole AS (
    SELECT convs.c, list(turn_key ORDER BY part, place) FILTER (turn_key IS NOT NULL) AS keys, list(chars ORDER BY part, place) FILTER (turn_key IS NOT NULL) AS sizes
    FROM convs LEFT JOIN parts USING (c) GROUP BY ALL),
steps AS (
    SELECT c, d AS depth, coalesce(keys, []) AS keys, coalesce(keys, [])[:d] AS node, coalesce(sizes[d], 0) AS chars
    FROM (SELECT *, unnest(range(0, len(coalesce(keys, [])) + 1)) AS d FROM whole)),
nodes AS (
    SELECT node, depth, min(c) AS conv_id, count(*) AS n_convs, max(chars) AS chars,
           sha256(coalesce(string_agg(CASE WHEN len(keys) = depth THEN c::VARCHAR END, ',' ORDER BY c), '')) AS ends_sha256
    FROM steps GROUP BY node, depth),
kids AS (SELECT node[:depth - 1] AS node, depth - 1 AS depth, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL),
grown AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN kids USING (node, depth)),
under AS (
    SELECT top.node, top.depth, count(*) FILTER (g.n_children = 0) AS n_leaves, sum((g.n_convs - 1) * g.chars) AS saved_tokens
    FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM grown) AS g JOIN nodes AS top ON top.depth = d AND top.node = g.node[:d] GROUP BY ALL)
SELECT grown.conv_id, grown.depth::BIGINT AS depth, up.conv_id AS parent_conv_id, grown.n_convs, grown.n_children, n_leaves,
       saved_tokens::BIGINT AS saved_tokens, grown.ends_sha256
FROM grown JOIN under USING (node, depth) LEFT JOIN nodes AS up ON up.depth = grown.depth - 1 AND up.node = grown.node[:grown.depth - 1]"""
