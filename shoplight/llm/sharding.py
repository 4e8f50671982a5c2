"""Sharding by a permutation-filled lookup table.

Every shard has its own preference order over the slots of a table of prime size:
``(offset + j * skip) mod slots`` visits each slot once because the size is prime. The shards
take turns, and each claims the first slot of its order that is still free, until the table is
full. Shards then differ by at most one slot, and when one shard leaves, few slots of the others
change hands. A row's key hashes to a slot; the table is broadcast, so placement is one lookup
and needs no shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoplight.llm.common import free_name, table

# A table above this size would not be a small broadcast any more.
MOST_SLOTS = 100_003


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def hash_sql(value: str, seed: str = "") -> str:
    """SQL (Spark's) of a 60-bit hash of a text."""
    salted = f"concat('{seed}', {value})" if seed else value
    return f"cast(conv(substr(md5({salted}), 1, 15), 16, 10) AS BIGINT)"


def lookup_table(spark: SparkSession, shards: list[str], slots: int = 2039) -> DataFrame:
    """Rows (slot, shard) of the filled table: one fold over the turns, all in SQL expressions.

    ``slots`` must be prime and should be some fifty times the number of shards or more; the work
    of filling grows with its square. Shards are distinct names without quotes.
    """
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be distinct names, one at least")
    if any("'" in s or "\\" in s for s in shards):
        raise ValueError("a shard's name holds a quote or a backslash")
    if not is_prime(slots) or slots < len(shards) or slots > MOST_SLOTS:
        raise ValueError(f"slots must be a prime between the number of shards and {MOST_SLOTS}")
    names = ", ".join(f"'{s}'" for s in shards)
    fill = f"""
    SELECT posexplode(aggregate(
        sequence(0, {slots - 1}),
        array_repeat(-1, {slots}),
        (owner, turn) -> transform(
            array(array_position(
                transform(sequence(0, {slots - 1}),
                          j -> owner[cast((offsets[turn % {len(shards)}] + j * skips[turn % {len(shards)}]) % {slots} AS INT)]),
                -1) - 1),
            first -> transform(owner, (o, slot) ->
                if(slot = (offsets[turn % {len(shards)}] + first * skips[turn % {len(shards)}]) % {slots},
                   turn % {len(shards)}, o)))[0]
        )) AS (slot, owner), names
    FROM (SELECT names,
                 transform(names, s -> {hash_sql('s', 'offset')} % {slots}) AS offsets,
                 transform(names, s -> {hash_sql('s', 'skip')} % {slots - 1} + 1) AS skips
          FROM (SELECT array({names}) AS names))"""
    return spark.sql(f"SELECT slot, names[owner] AS shard FROM ({fill})")


def shard(df: DataFrame, key: str, shards: list[str], slots: int = 2039, slot_column: str = "slot",
          shard_column: str = "shard") -> DataFrame:
    """``df`` with each row's slot and shard, by the text form of ``key``.

    A null key counts as the empty text, so such rows share one place. Repeated rows share a
    place. Columns of the same names in ``df`` are not touched: the new ones then get a trailing
    underscore. An empty table gives an empty table. The only broadcast is the lookup table, of
    at most ``MOST_SLOTS`` short rows; no row of ``df`` moves.
    """
    slot_name = free_name(df, slot_column)
    shard_name = free_name(df, shard_column)
    hashed = F.expr(f"{hash_sql(f'coalesce(cast(`{key}` AS STRING), {chr(39) * 2})')} % {slots}").cast("int")
    places = lookup_table(df.sparkSession, shards, slots).select(
        F.col("slot").alias(slot_name), F.col("shard").alias(shard_name))
    placed = df.withColumn(slot_name, hashed)
    return placed.join(F.broadcast(places), slot_name, "left").select(*df.columns, slot_name, shard_name)


SHARDS = [f"shard-{i:02d}" for i in range(32)]
SLOTS = 2039


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, slot and shard of every document over 32 shards."""
    return shard(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", SHARDS, SLOTS)


def _duck_hash(value: str, seed: str = "") -> str:
    return f"('0x' || substr(md5('{seed}' || {value}), 1, 15))::BIGINT"


SQL = f"""
WITH RECURSIVE shards AS (
    SELECT i, {_duck_hash("printf('shard-%02d', i)", "offset")} % {SLOTS} AS off,
           {_duck_hash("printf('shard-%02d', i)", "skip")} % {SLOTS - 1} + 1 AS skip
    FROM range({len(SHARDS)}) AS r(i)),
prefer AS (
    SELECT i, list((off + j * skip) % {SLOTS} ORDER BY j) AS wishes FROM shards, range({SLOTS}) AS r(j) GROUP BY i),
fill(turn, taken, owner) AS (
    SELECT 0::BIGINT, NULL::BIGINT, list_transform(range({SLOTS}), lambda x: -1::BIGINT)
    UNION ALL
    SELECT turn + 1, slot,
           list_concat(list_concat(owner[:slot], [turn % {len(SHARDS)}]), owner[slot + 2:])
    FROM (SELECT turn, owner, list_filter(wishes, lambda s: owner[s + 1] = -1)[1] AS slot
          FROM fill JOIN prefer ON i = turn % {len(SHARDS)} WHERE turn < {SLOTS})),
slots AS (
    SELECT taken AS slot, printf('shard-%02d', (turn - 1) % {len(SHARDS)}) AS shard FROM fill WHERE turn > 0)
SELECT doc_id, slot::INTEGER AS slot, shard
FROM (SELECT doc_id, {_duck_hash("coalesce(doc_id::VARCHAR, '')")} % {SLOTS} AS slot FROM documents)
LEFT JOIN slots USING (slot)"""
