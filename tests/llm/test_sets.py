"""Sharding, exact and near duplicates."""

from __future__ import annotations

import hashlib
import os
import random

import numpy as np
import pytest

import __spark_entry__ as entry_point
from shoplight.llm import exact_dedup, ngram_join, sharding
from shoplight.llm.queries import CHECKS, QUERIES
from shoplight.llm.signatures import shingle_sets, signatures, similar
from tests.harness import connect, differences
from tests.llm import brute

ROOT = f"/root/testdata/sf{os.environ.get('SHOPLIGHT_TEST_SF', '0.01')}"


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_query_agrees_with_sql(spark, name):
    assert differences(QUERIES[name](spark, ROOT), connect(ROOT), CHECKS[name]) == []


def test_queries_are_registered():
    assert set(QUERIES) | {"pipeline"} <= set(entry_point.queries())
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def filled(shards: list[str], slots: int) -> list[str]:
    def number(text: str) -> int:
        return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)

    wishes = [[(number(f"offset{s}") + j * (number(f"skip{s}") % (slots - 1) + 1)) % slots for j in range(slots)] for s in shards]
    owner: list[str | None] = [None] * slots
    for turn in range(slots):
        i = turn % len(shards)
        owner[next(s for s in wishes[i] if owner[s] is None)] = shards[i]
    return owner


def test_lookup_table_is_filled_in_turns(spark):
    shards = [f"s{i}" for i in range(7)]
    rows = sharding.lookup_table(spark, shards, 101).collect()
    assert [r.shard for r in sorted(rows)] == filled(shards, 101)


def test_a_leaving_shard_moves_few_others():
    shards = [f"s{i}" for i in range(10)]
    before, after = filled(shards, 997), filled(shards[:-1], 997)
    moved = sum(a != b for a, b in zip(before, after) if a != "s9")
    assert moved < 997 * 0.2
    assert max(before.count(s) for s in shards) - min(before.count(s) for s in shards) <= 1


def test_sharding_odd_input(spark):
    rows = [(None, "x"), (5, "y"), (5, "y")]
    found = sharding.shard(spark.createDataFrame(rows, "k long, Slot string"), "k", ["a", "b", "c"], 31)
    assert found.columns == ["k", "Slot", "slot_", "shard"]
    assert len(found.filter("k = 5").select("slot_", "shard").distinct().collect()) == 1
    assert found.filter("shard IS NULL").count() == 0 and found.count() == 3
    assert sharding.shard(spark.createDataFrame([], "k long"), "k", ["a"], 3).count() == 0
    for shards, slots in (([], 3), (["a", "a"], 5), (["a"], 4), (["it's"], 3)):
        with pytest.raises(ValueError):
            sharding.lookup_table(spark, shards, slots)


def test_exact_dedup_odd_input(spark):
    rows = [(3, "a b"), (1, "ab"), (2, " a\tb\n"), (4, None), (5, "  "), (6, ""), (None, "ab    "), (7, "zz"), (7, "zz"), (None, "q"), (8, "q")]
    rows += [(100 + i, "hot copy") for i in range(60)] + [(99, "hot  copy")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = exact_dedup.exact_groups(docs).collect()
    assert len(found) == len(rows)
    by_id = {r.doc_id: r for r in found if r.doc_id is not None}
    assert by_id[3].keep_id is None and by_id[3].group_size == 4  # "ab    " is longest, though it has no id
    assert by_id[4].keep_id == 5 and by_id[6].keep_id == 5
    assert by_id[8].kept and by_id[8].group_size == 2
    assert by_id[100].keep_id == 99 and by_id[100].group_size == 61
    assert sum(r.kept for r in found) == len({r.text_sha256 for r in found}) == 5
    assert by_id[8].text_sha256 == hashlib.sha256(b"q").hexdigest()
    kept = exact_dedup.without_copies(docs).collect()
    assert len(kept) == 5 and sum(r.doc_id == 7 for r in kept) == 1
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert exact_dedup.exact_groups(empty).count() == 0 and exact_dedup.without_copies(empty).count() == 0


def test_stages_keep_other_columns(spark):
    docs = spark.createDataFrame([(1, "a", "p"), (2, "a", "q")], "doc_id long, text string, dedup_digest string")
    assert [tuple(r) for r in exact_dedup.without_copies(docs).collect()] == [(1, "a", "p")]
    docs = docs.withColumnRenamed("dedup_digest", "component_id")
    assert [tuple(r) for r in ngram_join.without_near_copies(docs).collect()] == [(1, "a", "p")]


def test_similar_sets_share_a_signature():
    rng = random.Random(4)
    tried = 0
    for _ in range(2500):
        n = rng.choice([5, 6, 9, 14, 20, 25, 33, 60, 120, 300, 700])
        pool = [rng.getrandbits(64) for _ in range(2 * n)]
        a = set(pool[:n])
        b = set(a)
        for _ in range(rng.randint(1, max(1, n // 8))):
            b.discard(rng.choice(pool[:n])) if rng.random() < 0.5 else b.add(rng.choice(pool))
        x, y = (np.array(sorted(s), dtype=np.uint64) for s in (a, b))
        if a != b and similar(x, y):
            tried += 1
            signature, owner = signatures([x, y])
            assert set(signature[owner == 0].tolist()) & set(signature[owner == 1].tolist())
    assert tried > 1000


def test_shingles_are_the_contract_s():
    texts = ["A b\tc D\x0be f", "ÀB x", "", "  \n", "one", "a a a a a a a", "x\x1cy z"]
    sets = shingle_sets([t.encode() for t in texts])
    assert [len(s) for s in sets] == [len(brute.shingles(t)) for t in texts]
    assert np.array_equal(shingle_sets([b"A b c d e"])[0], shingle_sets([b" a B  c\nd E "])[0])
    assert not np.array_equal(shingle_sets([b"a b"])[0], shingle_sets([b"a b b"])[0])


def near_rows(rng: random.Random) -> list[tuple[int, str]]:
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    rows = []
    for _ in range(12):  # chains of versions, each near the one before only
        words = [word() for _ in range(rng.choice([8, 30, 80, 200]))]
        for _ in range(rng.randint(2, 8)):
            rows.append(" ".join(words))
            for _ in range(max(1, len(words) // 60)):
                words[rng.randrange(len(words))] = word()
    base = [word() for _ in range(60)]
    for _ in range(60):  # a large group around a text
        some = list(base)
        for _ in range(rng.randint(0, 2)):
            some[rng.randrange(60)] = word()
        rows.append(" ".join(some))
    common = " ".join(word() for _ in range(50))
    rows += [f"{common} {' '.join(word() for _ in range(rng.randint(5, 40)))}" for _ in range(60)]
    rows += rows[:10] + ["", " ", "short text", "Short  TEXT"]
    rng.shuffle(rows)
    return list(enumerate(rows, 10))


@pytest.mark.parametrize("block", [512, 7])
def test_near_duplicates_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rows = near_rows(random.Random(block))
    docs = spark.createDataFrame([*rows, (None, "short text"), (9, None)], "doc_id long, text string").repartition(6)
    found = ngram_join.near_duplicates(docs).collect()
    assert len(found) == len(rows) + 2
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found if r.doc_id is not None} == brute.near_components([*rows, (9, None)])
    assert [tuple(r) for r in found if r.doc_id is None] == [(None, 1, None)]


def test_near_duplicates_of_nothing(spark):
    assert ngram_join.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_near_duplicates_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{ROOT}/documents.parquet").collect()]
    found = QUERIES["op2_ngram_join"](spark, ROOT).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute.near_components(docs)
