"""Substring removal, languages, pseudonyms, pieces, quality, packing, neighbours and the pipeline."""

from __future__ import annotations

import hashlib
import itertools
import os
import random
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from shoplight.llm import language, neighbours, packing, pieces, pseudonyms, quality, suffix_dedup
from shoplight.llm.queries import QUERIES
from shoplight.llm.suffix_array import suffix_array
from tests.llm import brute

ROOT = f"/root/testdata/sf{os.environ.get('SHOPLIGHT_TEST_SF', '0.01')}"
EMPTY = "doc_id long, text string"


def documents(spark):
    return spark.read.parquet(f"{ROOT}/documents.parquet")


def test_suffix_arrays():
    rng = random.Random(1)
    for _ in range(400):
        a = rng.choice([1, 2, 3, 250])
        t = [rng.randint(1, a) for _ in range(rng.randint(1, 60))] + [0]
        want = sorted(range(len(t)), key=lambda i: t[i:])
        assert suffix_array(np.array(t), a + 1).tolist() == want
        assert suffix_array(np.array(t), 1000).tolist() == want


def odd_texts(rng: random.Random) -> list[str | None]:
    base = "".join(rng.choice("ab") for _ in range(2500))
    texts = ["a" * 500, "ab" * 300, "abc" * 40 + "x" + "abc" * 60, "é" * 120, "\0" * 250, None, "", "z" * 99, "z" * 100, "z" * 100, "y" * 101]
    for _ in range(50):
        at = rng.randint(0, 2400)
        texts.append(base[at : at + rng.randint(50, 400)] + "".join(rng.choice("ab") for _ in range(50)) + base[: rng.randint(0, 200)])
    return texts


@pytest.mark.parametrize("shard", [1 << 20, 1000])
def test_removed_bytes_against_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", shard)
    rows = list(enumerate(odd_texts(random.Random(2))))
    docs = spark.createDataFrame(rows, EMPTY).repartition(6)
    found = {r.doc_id: (r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), r.kept_sha256) for r in suffix_dedup.repeated_spans(docs).collect()}
    assert found == brute.removed(rows)
    for r in suffix_dedup.repeated_spans(docs, with_text=True).filter("kept IS NOT NULL").collect():
        assert hashlib.sha256(r.kept).hexdigest() == r.kept_sha256


def test_hot_anchors_are_split(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", 4000)
    rng = random.Random(5)
    some = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage = some(400)
    rows = [(i, some(150) + rng.choice("xy") + passage + rng.choice("xy") + some(150)) for i in range(200)]
    docs = spark.createDataFrame([*rows, rows[7]], EMPTY).repartition(6)
    dealt = suffix_dedup.dealt_segments(suffix_dedup.keyed(docs, "doc_id", "text"))
    matches = suffix_dedup.matched(dealt).filter("anchor IS NOT NULL")
    sizes = [r for r in matches.groupBy("anchor", "hot").count().collect()]
    assert any(r.hot for r in sizes) and all(r["count"] * 100 <= 4000 for r in sizes if not r.hot)
    # Equal segments of a pack go to their anchor once.
    least = np.array([np.frombuffer(r.payload, dtype="<u4", count=2)[1] for r in dealt.filter("bucket >= 0").collect()]).sum()
    every = sum(len(suffix_dedup.segments([t.encode()])["owner"]) for _, t in rows)
    assert least < every - 5 * 150
    found = {r.doc_id: (r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), r.kept_sha256) for r in suffix_dedup.repeated_spans(docs).collect()}
    want = brute.removed(rows)
    assert found == want


def test_removed_bytes_odd_rows(spark):
    docs = spark.createDataFrame([(1, "k" * 300), (1, "k" * 300), (None, "k" * 300), (None, None)], EMPTY)
    found = sorted((r.doc_id or 0, r.n_bytes, [tuple(s) for s in r.spans]) for r in suffix_dedup.repeated_spans(docs).collect())
    assert found == [(0, 0, []), (0, 300, [(0, 300)]), (1, 300, [(1, 300)]), (1, 300, [(1, 300)])]
    assert suffix_dedup.repeated_spans(spark.createDataFrame([], EMPTY)).count() == 0


def test_removed_bytes_query(spark):
    rows = [(r.doc_id, r.text) for r in documents(spark).collect()]
    found = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in QUERIES["op3_suffix_dedup"](spark, ROOT).collect()}
    assert found == brute.removed(rows)


def test_long_texts_are_cut_into_overlapping_pieces(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE", 150)
    text = bytes(random.Random(3).choices(range(256), k=1000))
    windows = [at + i for at, piece in suffix_dedup.pieces_of(text) for i in range(len(piece) - 99)]
    assert windows == list(range(901))


def test_language_of_held_out_documents(spark):
    truth = {r.doc_id: r.lang for r in documents(spark).collect()}
    rows = QUERIES["op4_language"](spark, ROOT).collect()
    assert len(rows) == len(truth)
    held = [r for r in rows if r.held_out]
    assert held and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert np.mean([truth[r.doc_id] == r.lang_pred for r in held]) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_odd_input(spark):
    machines = language.train(documents(spark))
    rows = [(1, None), (2, ""), (3, "12 !!"), (None, "der die und das ist nicht ein"), (4, "x"), (4, "x"), (5, "les des une dans " * 20_000)]
    docs = spark.createDataFrame(rows, EMPTY)
    found = sorted((r.doc_id or 0, r.lang_pred, r.score) for r in language.identify(docs, machines).collect())
    assert [f[1] for f in found[:4]] == ["de", "und", "und", "und"] and found[4] == found[5] and found[6][1] == "fr"
    assert all(r.lang_pred == "und" for r in language.identify(docs, None).collect())
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert language.train(empty) is None and language.identify(empty, machines).count() == 0
    alone = language.fit(np.ones((2, language.BINS)) / language.BINS, ["en", "en"])
    assert alone.predict([b"hello"])[0] == ["en"]


def test_prediction_does_not_depend_on_neighbours(spark):
    machines = language.train(documents(spark))
    texts = [r.text.encode() for r in documents(spark).limit(20).collect()]
    together = machines.predict(texts)[1]
    assert np.allclose(together, [machines.predict([t])[1][0] for t in texts], atol=1e-12)


def replaced(spark, texts: list[str | None], key: str = "k") -> list[str | None]:
    docs = spark.createDataFrame(list(enumerate(texts)), EMPTY)
    return [r.text for r in pseudonyms.pseudonymise(docs, key).orderBy("doc_id").collect()]


def luhn(digits: str) -> bool:
    values = [int(c) for c in reversed(digits)]
    return sum(v if i % 2 == 0 else 2 * v - 9 * (v > 4) for i, v in enumerate(values)) % 10 == 0


def test_pseudonyms_keep_format_and_link(spark):
    texts = ["card 4539578763621486 end", "4539-5787-6362-1486", "no card 4539578763621487", "a.b9@mail.example.com", "to a.b9@mail.example.com!",
             "on 1999-02-28", "28.02.1999", "28/02/1999", "never 1999-02-30", "ip 10.20.30.40.", "no ip 300.1.2.3", "ssn 123-45-6789", "not 666-45-6789",
             "+1 (017) 555-7713%%%", 'key "b44e15e09fd311c3cf3163b66d5a9875b883d8ce"', "DE89370400440532013000", "DE89370400440532013001",
             None, "", "no value 4.0. and 12", "x 1@b.co"]
    out = replaced(spark, texts)
    card = re.search(r"\d{16}", out[0])[0]
    assert card != "4539578763621486" and luhn(card) and out[1].replace("-", "") == card
    for same in (2, 8, 10, 12, 16, 17, 18, 19):
        assert out[same] == texts[same]
    assert out[3] != texts[3] and out[4] == f"to {out[3]}!" and re.fullmatch(r"[a-z]\.[a-z]\d@mail\.example\.com", out[3])
    year, month, day = re.fullmatch(r"on (\d{4})-(\d\d)-(\d\d)", out[5]).groups()
    assert out[6] == f"{day}.{month}.{year}" and out[7] == f"{day}/{month}/{year}" and out[5] != texts[5]
    assert all(int(o) < 256 for o in re.fullmatch(r"ip ([\d.]+)\.", out[9])[1].split("."))
    assert re.fullmatch(r"ssn (?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4}", out[11]) and out[11] != texts[11]
    assert re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}%%%", out[13]) and out[13] != texts[13]
    assert re.fullmatch(r'key "[0-9a-f]{40}"', out[14]) and out[14] != texts[14]
    iban = out[15][4:] + out[15][:4]
    assert out[15] != texts[15] and int("".join(str(int(c, 36)) for c in iban)) % 97 == 1
    assert replaced(spark, texts, "other")[0] != out[0]


def test_pseudonyms_of_other_forms(spark):
    texts = ["(555) 123-4567", "555-123-4567", "+1 555.123.4567", "+33 1 42 68 53 00", "01 42 68 53 00", "020 7946 0958", "1-800-555-0199",
             "DE89 3704 0044 0532 0130 00", "BE68 5390 0754 7034 THE END", "12/25/1999", "03/14/2001", "1/25/1999", "1/2/1999", "25.1.1999", "1999-1-2",
             "иван@mail.ru", "李雷@b.cn", "DE12 4539 5787 6362 1486 00"]
    out = replaced(spark, texts)
    for before, after in zip(texts, out):
        assert after != before and (re.sub("[0-9]+", "0", after) == re.sub("[0-9]+", "0", before) or re.search("DE89|BE68|@", before))
    assert out[0].replace("(", "").replace(") ", "-") == out[1] == out[2][3:].replace(".", "-") and out[3][4:] == out[4][1:]
    for iban in (out[7], out[8].removesuffix(" THE END")):
        plain = iban.replace(" ", "")
        assert int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1
    assert all(int(out[i].split("/")[1]) > 12 for i in (9, 10, 11))
    assert re.fullmatch("[Ѐ-ӿԀ-ԯᲀ-ᲈꙀ-ꚟ]{4}@mail.ru", out[15]) and re.fullmatch("[一-鿿]{2}@b.cn", out[16])
    assert out[17][:4] == "DE12" and out[17][-3:] == " 00" and luhn(out[17][5:24].replace(" ", ""))
    kept = ["99/99/1999", "version 1.2.3", "DE89 3704 0044 0532 0130 01", "+1 2 3", "1/2/3"]
    assert replaced(spark, kept) == kept


def test_permutations_are_one_to_one(spark):
    numbers = spark.range(60 * 7).select(pseudonyms.permuted_number(pseudonyms.F.col("id"), 60, 7, "k").alias("n"))
    assert sorted(r.n for r in numbers.collect()) == list(range(420))
    codes = spark.range(1000).select(pseudonyms.F.lpad(pseudonyms.F.col("id").cast("string"), 3, "0").alias("v"))
    made = [r.p for r in codes.select(pseudonyms.permuted_symbols(pseudonyms.F.col("v"), "k").alias("p")).collect()]
    assert sorted(made) == [f"{i:03d}" for i in range(1000)]


def test_pseudonyms_feistel_against_plain_version(spark):
    def shifted(half: str, other: str, turn: int) -> str:
        stream = hashlib.sha512(f"k|{turn}|{other}".encode()).hexdigest()
        return "".join(str((int(c) + int(stream[i % 32 * 4 : i % 32 * 4 + 4], 16)) % 10) for i, c in enumerate(half))

    def plain(v: str) -> str:
        a, b = v[: len(v) // 2], v[len(v) // 2 :]
        for turn in range(1, pseudonyms.ROUNDS + 1):
            a, b = b, shifted(a, b, turn)
        return a + b

    values = ["7", "42", "453957876362148", "0" * 31]
    docs = spark.createDataFrame([(v,) for v in values], "v string")
    assert [r.p for r in docs.select(pseudonyms.permuted_symbols(pseudonyms.F.col("v"), "k").alias("p")).collect()] == [plain(v) for v in values]


def test_pii_query_leaves_other_documents_alone(spark):
    before = {r.doc_id: r.text for r in documents(spark).collect()}
    after = {r.doc_id: r.text for r in QUERIES["op5_pii"](spark, ROOT).collect()}
    value = re.compile("|".join([r"@mail\d", r"\+1 \(\d{3}\) \d{3}-\d{4}", r"\b[0-9a-fA-F]{28,}\b", r"\b\d{16}\b", r"\b\d+\.\d+\.\d+\.\d+\b"]))
    assert set(before) == set(after)
    assert all(after[i] == t for i, t in before.items() if not value.search(t))
    for i, t in before.items():
        for found in re.findall(r"[\w.]+@mail\d+\.example\.com|\+1 \(\d{3}\) \d{3}-\d{4}", t):
            assert found not in after[i]


@pytest.mark.parametrize("least", range(2, 11))
def test_packing_tries_targets_between_steps(monkeypatch, least):
    monkeypatch.setattr(packing, "best_fit", lambda counts, capacity: [(((1, 1),), 10)])
    monkeypatch.setattr(packing, "completed", lambda counts, capacity, target, budget: [(((1, 1),), target)] if target >= least else None)
    assert sum(times for _, times in packing.plan({1: 10}, 5)) == least


def test_pieces_equal_the_library_s(spark):
    library = pieces.encoder(pieces.model_path()).library
    rng = random.Random(3)
    texts = [None, "", " ", "▁x", "a\0b", "<s> </s> <0x41>"] + ["".join(rng.choice(" a b\n\té￼▁xyz😀ñ中 the ing.,'s") for _ in range(rng.randint(0, 40))) for _ in range(400)]
    texts.append("word " * 30_000)
    docs = spark.createDataFrame([*enumerate(texts), (None, "a")], EMPTY).repartition(3)
    rows = {r.doc_id: r for r in pieces.encoded(docs, pieces.model_path(), with_values=True).collect()}
    assert len(rows) == len(texts) + 1
    for i, text in enumerate(texts):
        ids = library.encode(text or "")
        r = rows[i]
        assert r.ids == ids and r.n_tokens == len(ids) and r.decoded == library.decode(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest()
    assert pieces.encoded(spark.createDataFrame([], EMPTY), pieces.model_path()).count() == 0


def test_pieces_query(spark):
    library = pieces.encoder(pieces.model_path()).library
    rows = {r.doc_id: r for r in QUERIES["op6_pieces"](spark, ROOT).collect()}
    for d in documents(spark).collect():
        assert rows[d.doc_id].ids_sha256 == hashlib.sha256(",".join(map(str, library.encode(d.text))).encode()).hexdigest()


def test_quality_of_held_out_documents(spark):
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{ROOT}/labels.parquet").collect()}
    rows = QUERIES["op8_quality"](spark, ROOT).collect()
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert len(rows) == documents(spark).count() and len(held) > 50
    assert np.mean([truth[r.doc_id] == r.predicted for r in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)


def test_quality_odd_input(spark):
    network = quality.train(documents(spark), spark.read.parquet(f"{ROOT}/labels.parquet"))
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "x"), (3, "w " * 200_000), (4, "a b"), (4, "a b")], EMPTY)
    found = sorted((r.doc_id or 0, r.score) for r in quality.scored(docs, network).collect())
    assert len(found) == 6 and found[1][1] == found[2][1] and found[4] == found[5]
    assert {r.score for r in quality.scored(docs, None).collect()} == {0.5}
    labels = spark.createDataFrame([(1, 1), (2, 1), (None, 0), (3, None)], "doc_id long, quality int")
    assert quality.train(docs, labels) is None
    assert quality.scored(spark.createDataFrame([], EMPTY), network).count() == 0


def test_quality_gradients():
    """The fitted network tells bags with one odd passage from others."""
    rng = np.random.default_rng(1)
    bags, marks = [], []
    for i in range(120):
        bag = np.abs(rng.normal(0, 0.05, (rng.integers(1, 9), quality.BINS)))
        if i % 2:
            bag[rng.integers(len(bag)), :5] += 1.0
        bags.append(bag)
        marks.append(i % 2)
    network = quality.fit(bags, np.array(marks))
    scores = []
    for bag in bags:
        code, attention = network.parts(bag)
        share = np.exp(attention - attention.max())
        z = (share[:, None] * code).sum(axis=0) / share.sum()
        scores.append(float((z @ network.weights["out"] + network.weights["out0"])[0] > 0))
    assert np.mean(np.array(scores) == marks) > 0.95


def test_packing_is_right_and_tight(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(packing.vocabulary_path())
    docs = documents(spark)
    extra = spark.createDataFrame([(-1, None), (-2, ""), (None, "null id"), (-3, "same"), (-3, "same"), (-4, "Long. " * 30_000), (-5, "İΣ <|endoftext|>\x85²3")], EMPTY)
    rows = packing.pack(docs.select("doc_id", "text").unionByName(extra).repartition(5), packing.vocabulary_path()).collect()
    ids = {r.doc_id: library.encode(r.text or "", add_special_tokens=False).ids + [1] for r in docs.unionByName(extra, allowMissingColumns=True).collect()}
    for r in rows:
        own = np.array(ids[r.doc_id][r.start : r.start + r.length], dtype="<u4")
        assert len(own) == r.length and r.ids_crc32 == zlib.crc32(own.tobytes())
    assert {r.doc_id for r in rows} == set(ids) and sum(r.doc_id == -3 for r in rows) == 2
    sequences = len({r.sequence_id for r in rows})
    assert sequences == -(-sum(r.length for r in rows) // 4096)
    assert packing.pack(spark.createDataFrame([], EMPTY), packing.vocabulary_path()).count() == 0


def test_packing_query(spark):
    rows = QUERIES["op9_packing"](spark, ROOT).collect()
    assert brute.packed_right(rows) == -(-sum(r.length for r in rows) // 4096)


def smallest_packing(lengths: list[int], capacity: int) -> int:
    """By trying every placement, longest first."""
    best = [len(lengths)]

    def place(i: int, rooms: list[int]) -> None:
        if len(rooms) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(rooms)
            return
        for room in set(rooms):
            if room >= lengths[i]:
                rest = list(rooms)
                rest.remove(room)
                place(i + 1, [*rest, room - lengths[i]])
        place(i + 1, [*rooms, capacity - lengths[i]])

    lengths = sorted(lengths, reverse=True)
    place(0, [])
    return best[0]


def test_plans_against_every_placement():
    rng = random.Random(8)
    for _ in range(150):
        lengths = [rng.randint(1, 20) for _ in range(rng.randint(1, 9))]
        counts = {n: lengths.count(n) for n in lengths}
        made = packing.plan(counts, 20)
        placed = sorted(itertools.chain.from_iterable([n] * (k * times) for pattern, times in made for n, k in pattern))
        assert placed == sorted(lengths) and all(sum(n * k for n, k in pattern) <= 20 for pattern, _ in made)
        assert sum(times for _, times in made) == smallest_packing(lengths, 20)


def test_neighbours_of_given_vectors(spark):
    rows = {r.vec_id: np.array(r.embedding, dtype=float) for r in spark.read.parquet(f"{ROOT}/embeddings.parquet").collect()}
    found = QUERIES["op10_neighbours"](spark, ROOT).collect()
    hits = total = 0
    for q in [i for i in rows if i % 100 == 0]:
        want = sorted((float(np.sqrt(((rows[q] - v) ** 2).sum())), i) for i, v in rows.items() if i != q)[:10]
        got = sorted((r.rank, r.score, r.vec_id) for r in found if r.query_id == q)
        assert [g[0] for g in got] == list(range(1, 11)) and [g[1:] for g in got] == sorted(g[1:] for g in got)
        assert all(abs(s - np.sqrt(((rows[q] - rows[i]) ** 2).sum())) < 1e-12 for _, s, i in got)
        hits += len({i for _, i in want} & {g[2] for g in got})
        total += 10
    assert hits / total >= 0.9


def test_neighbours_recall_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 500)
    rng = np.random.default_rng(5)
    data = rng.normal(size=(3000, 24)) * (1 + rng.integers(0, 3, (3000, 1)))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "vec_id long, embedding array<double>").repartition(4)
    found = neighbours.nearest(frame, k=5, every=50).collect()
    hits = 0
    for q in range(0, 3000, 50):
        gaps = np.sqrt(((data - data[q]) ** 2).sum(axis=1))
        gaps[q] = np.inf
        hits += len(set(np.argsort(gaps)[:5].tolist()) & {r.vec_id for r in found if r.query_id == q})
    assert hits / (60 * 5) >= 0.9


def test_neighbours_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]),
            (7, [None, 1.0]), (None, [1.0, 1.0]), (8, [1.0]), (9, [1.0, 0.0]), (100, [3.0]), (200, [5.0, 5.0, 5.0]), (2, [0.0, 2.0]), (10, [])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = {(r.query_id, r.rank): (r.vec_id, r.score) for r in neighbours.nearest(frame, k=10).collect()}
    assert [found[0, k][0] for k in (1, 2, 3, 4)] == [1, 9, 2, 2] and (0, 5) not in found
    assert found[0, 1][1] == 0.0 and found[100, 1] == (8, 2.0) and (200, 1) not in found
    assert neighbours.nearest(frame.limit(0)).count() == 0


def test_pipeline_stage_by_stage(spark):
    """Planted rows, and every stage against its plain version."""
    base = documents(spark).limit(300)
    some = [(r.doc_id, r.text) for r in base.collect()]
    planted = [(10_001, "12 345 !!"), (10_002, some[0][1]), (10_003, some[1][1] + "  "), (10_004, some[2][1] + " one more"), (10_005, "write to jane.doe7@mail.example.com today please")]
    docs = base.unionByName(spark.createDataFrame(planted, EMPTY), allowMissingColumns=True)
    stages = dict(corpus_pipeline.STAGES)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "exact_dedup", "near_duplicates", "pii", "packing"]
    kept = stages["language"](spark, docs, ROOT)
    assert kept.columns == docs.columns
    left = {r.doc_id: r.text for r in kept.collect()}
    assert left == {i: t for i, t in [*some, *planted] if re.search(r"[^\W\d_]", t or "")}
    kept = stages["exact_dedup"](spark, kept, ROOT)
    assert sorted(r.doc_id for r in kept.collect()) == brute.exact_kept(list(left.items()))
    left = {r.doc_id: r.text for r in kept.collect()}
    kept = stages["near_duplicates"](spark, kept, ROOT)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, (_, c) in brute.near_components(list(left.items())).items() if i == c)
    clean = stages["pii"](spark, kept, ROOT)
    assert clean.columns == docs.columns and clean.count() == kept.count()
    assert clean.filter("text LIKE '%jane.doe7@%'").count() == 0
    rows = stages["packing"](spark, clean, ROOT).collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in kept.collect()}
    brute.packed_right(rows)


def test_pipeline_of_nothing(spark):
    docs = documents(spark).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, ROOT)
    assert docs.count() == 0


@pytest.mark.parametrize("k, repeat", [(301, 1), (301, 9), (5000, 1), (5000, 4)])
def test_suffix_array_of_names(k, repeat):
    rng = np.random.default_rng(k + repeat)
    for n in (0, 1, 2, 30, 240):
        t = np.append(np.tile(rng.integers(1, k, n), repeat), 0)
        names = t.tolist()
        assert suffix_array(t, k).tolist() == sorted(range(len(names)), key=lambda i: names[i:])
