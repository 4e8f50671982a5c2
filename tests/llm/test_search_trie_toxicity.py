"""Ranked search, the trie of conversations and toxicity, and long or odd input of earlier operators."""

from __future__ import annotations

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from shoplight.llm import ngram_join, pieces, prefix_trie, pseudonyms, quality, ranked_search, toxicity
from shoplight.llm.common import bounded_sample
from shoplight.llm.queries import QUERIES
from shoplight.llm.treap import Treap

ROOT = f"/root/testdata/sf{os.environ.get('SHOPLIGHT_TEST_SF', '0.01')}"
EMPTY = "doc_id long, text string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def lowered(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


@pytest.mark.parametrize("seed", range(6))
def test_treap_against_every_column(seed):
    rng = np.random.default_rng(seed)
    rows, columns = int(rng.integers(1, 60)), int(rng.integers(1, 90))
    grid = np.where(rng.random((rows, columns)) < 0.3, rng.integers(1, 4 if seed % 2 else 2000, (rows, columns)), 0)
    grid[0, 0] = 1
    at = np.nonzero(grid)
    built = Treap.build(at[0], at[1], grid[at])
    treap = Treap.unpacked(built.height, *built.packed())
    assert np.array_equal(treap.values, built.values) and np.array_equal(treap.masks, built.masks)
    names = np.sort(rng.integers(0, 500, columns))
    for _ in range(20):
        chosen = rng.choice(rows, size=min(rows, 7), replace=False)
        weights = rng.integers(0, 5, len(chosen))
        scores = weights @ grid[chosen]
        want = sorted((-int(s), c) for c, s in enumerate(scores) if s > 0)
        assert treap.search(chosen, weights, 5, names) == [(-s, c) for s, c in want[:5]]
        if len(want) > 3:
            least = (-want[3][0], int(names[want[3][1]]))
            found = treap.search(chosen, weights, 5, names, least)
            assert found[:4] == [(-s, c) for s, c in want[:4]]


def plain_ranking(docs, items, top=20):
    counted = [(i, Counter(WORD.findall(lowered(t or "")))) for i, t in docs]
    counted = [(i, c) for i, c in counted if c]
    holding, total = len(counted), sum(sum(c.values()) for _, c in counted)
    holders = Counter(w for _, c in counted for w in c)
    weight = lambda w: math.floor(1000 * math.log((2 * holding + 2) / (2 * holders[w] + 1)))
    found = []
    for item, text in items:
        scores = []
        for place, (i, c) in enumerate(counted):
            m = 75 + 25 * sum(c.values()) * holding // total
            score = sum(weight(w) * (10**9 * c[w] // (1000 * c[w] + 12 * m)) for w in WORD.findall(lowered(text or "")) if w in c)
            if score > 0:
                scores.append((-score, i is None, i or 0, place))
        found += [(item, rank, None if s[1] else s[2], -s[0]) for rank, s in enumerate(sorted(scores)[:top], 1)]
    return sorted(found, key=str)


@pytest.mark.parametrize("small", [False, True])
def test_ranked_search_against_every_document(spark, monkeypatch, small):
    if small:
        for name, value in (("BLOCK_DOCS", 5), ("ITEMS", 2), ("SLICE_BYTES", 16), ("PIECE_BYTES", 7)):
            monkeypatch.setattr(ranked_search, name, value)
    rng = random.Random(4)
    words = ["the", "of", "Idea", "été", "x1", "42", "ΣΑΣ", "zebra", "mañana", "a"]
    docs = [(i, " ".join(rng.choices(words, weights=range(10, 0, -1), k=rng.randint(0, 30)))) for i in range(90)]
    docs += [(200 + i, "zebra crossing; zebra") for i in range(40)] + [(7, "repeated zebra")] * 3
    docs += [(300, None), (301, ""), (302, "?!"), (None, "zebra zebra"), (None, None), (303, "long " * 5000 + "zebra")]
    items = [(1, "the ZEBRA, the zebra"), (2, "été mañana a"), (3, None), (4, "unknown"), (None, "42"), (5, "crossing")]
    frame = spark.createDataFrame(docs, EMPTY).withColumn("score", F.lit("clash")).withColumn("rank", F.lit(1)).repartition(5)
    blocks, holding = ranked_search.index(frame)
    found = ranked_search.ranked(blocks, holding, spark.createDataFrame(items, "item_id long, text string"))
    assert sorted([tuple(r) for r in found.collect()], key=str) == plain_ranking(docs, items)


def test_ranked_search_of_nothing(spark):
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    blocks, holding = ranked_search.index(spark.createDataFrame([], EMPTY))
    assert holding == 0 and ranked_search.ranked(blocks, holding, items).count() == 0
    blocks, holding = ranked_search.index(spark.createDataFrame([(1, "a b"), (2, "b")], EMPTY))
    assert ranked_search.ranked(blocks, holding, items.limit(0)).count() == 0


def plain_trie(rows):
    own = defaultdict(list)
    order = lambda r: (r[1] is not None, r[1] or 0, hashlib.md5((md5(r[2] or "") + md5(r[3] or "")).encode()).hexdigest())
    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
    for c, _, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], order(r))):
        own[c].append((role or "", text or ""))
    whole = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        whole[c] = tuple(own.get(c - int(math.fmod(c, 100)), [])[:h] + own[c][h:])
    members = defaultdict(list)
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    result = []
    for node, inside in members.items():
        below = [n for n in members if n[: len(node)] == node]
        children = [n for n in below if len(n) == len(node) + 1]
        ends = ",".join(str(c) for c in sorted(inside) if whole[c] == node)
        result.append((
            min(inside), len(node), min(members[node[:-1]]) if node else None, len(inside), len(children),
            sum(1 for n in below if not any(m[: len(n)] == n and len(m) == len(n) + 1 for m in below)),
            sum((len(members[n]) - 1) * len(n[-1][1]) for n in below if n), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(result, key=str)


def test_trie_against_plain_version(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE_BYTES", 12)
    rng = random.Random(6)
    rows = []
    for c in [*range(0, 30), *range(100, 125), 250, 251, -7, -150]:
        for t in range(rng.randint(1, 9)):
            rows.append((c, t, rng.choice(["user", "bot", None]), rng.choice(["hi", "hé 😀", "", None])))
    rows += [(500 + i, t, "user", f"t{t}") for i in range(40) for t in range(7)]  # many equal ones
    rows += [(900, None, "a", "first"), (900, None, "b", "second"), (900, 3, "a", "x"), (900, 3, "a", "x"), (None, 1, "a", "lost"), (None, None, None, None)]
    rows += [(700, t, "user", "long " + str(t % 3)) for t in range(400)]  # over several chunks
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("depth", F.lit("clash")).repartition(7)
    found = prefix_trie.conversation_trie(frame)
    assert found.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted([tuple(r) for r in found.collect()], key=str) == plain_trie(rows)


def test_trie_of_nothing(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert prefix_trie.conversation_trie(empty).count() == 0


def test_trie_turnless_conversations_are_members_of_the_root(spark):
    alone = next(c for c in range(1, 99) if zlib.crc32(str(c).encode()) % 6)  # its opening would come from conversation 0
    frame = spark.createDataFrame([(alone, 0, "user", "gone")], "conv_id long, turn long, role string, text string")
    ends = hashlib.sha256(str(alone).encode()).hexdigest()
    assert [tuple(r) for r in prefix_trie.conversation_trie(frame).collect()] == [(alone, 0, None, 1, 0, 1, 0, ends)]


def plain_kernel(a: str, b: str) -> float:
    """The normalised kernel of two single words."""
    def features(word: str) -> dict[str, float]:
        word, found = f"_{word}_", defaultdict(float)
        for i in range(len(word)):
            for offsets in toxicity.PATTERNS:
                if i + offsets[-1] < len(word):
                    found["".join(word[i + o] for o in offsets)] += toxicity.SKIPPED[offsets[-1] - toxicity.ORDER + 1]
        return found

    x, y = features(a), features(b)
    dot = sum(x[k] * y.get(k, 0) for k in x)
    norms = [math.sqrt(sum(toxicity.SKIPPED[o[-1] - toxicity.ORDER + 1] ** 2 for i in range(len(w) + 2) for o in toxicity.PATTERNS
                           if i + o[-1] < len(w) + 2)) for w in (a, b)]
    return dot / (norms[0] * norms[1])


def test_kernel_against_plain_version():
    words = ["idiot", "idxiot", "idio", "moron", "pathetic", "banana", "ananas", "abcd"]
    strings = [toxicity.variants(w)[0] for w in words]
    owner, code, weight = toxicity.features(strings)
    codes = np.unique(code)
    dense = np.zeros((len(codes), len(words)))
    np.add.at(dense, (np.searchsorted(codes, code), owner), weight)
    want = np.array([[plain_kernel(a, b) for b in words] for a in words])
    assert np.allclose(toxicity.kernel(strings, codes, dense), want, atol=1e-5)
    # Folded into one weight per subsequence, the machine gives the same sums for words in texts.
    machine = toxicity.Machine(codes, dense[:, 0].astype(np.float32))
    sums = machine.sums([f"Well, {w}!".encode() for w in words], machine.table())[0]
    assert np.allclose(sums, np.maximum(want[:, 0], machine.sums([b"well"], machine.table())[0]), atol=1e-4)


def test_toxicity_of_held_out_documents(spark):
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{ROOT}/labels.parquet").collect()}
    rows = QUERIES["op13_toxicity"](spark, ROOT).collect()
    assert len(rows) == spark.read.parquet(f"{ROOT}/documents.parquet").count()
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    caught = [r.predicted for r in held if truth[r.doc_id] == 1]
    clean = [r.predicted for r in held if truth[r.doc_id] == 0]
    assert np.mean(caught) > 0.6 and np.mean(clean) < 0.05
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)


def test_toxicity_catches_spaced_and_marked_words(spark):
    labels = [(i, int(i % 4 == 0)) for i in range(900)]
    rng = random.Random(2)
    calm = ["garden", "morning", "letter", "window", "station", "market", "winter", "summer", "paper", "river", "music", "number"]
    rude = ["blockhead", "nitwit", "scoundrel"]
    text = lambda bad: " ".join([*rng.choices(calm, k=9), *([rng.choice(rude)] if bad else []), *rng.choices(calm, k=9)]) + "."
    docs = spark.createDataFrame([(i, " ".join(text(bad and s == 1) for s in range(3))) for i, bad in labels], EMPTY)
    machine = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    forms = ["a nitwit here", "what a N-I-T-W-I-T", "you b l o c k h e a d you", "s.c.o.u.n.d.r.e.l", "SC0UNDREL", "a scoundrrel"]
    tests = [(i, f"The garden of the river. {form} in the winter.") for i, form in enumerate(forms)]
    tests += [(100, " ".join(text(False) for _ in range(2000))), (101, None), (102, ""), (103, "12 34"), (None, "nitwit"), (104, "nitwit"), (104, "nitwit"),
              (105, "nit wit " * 3), (106, "x" * 200_000)]
    found = toxicity.scored(spark.createDataFrame(tests, EMPTY), machine).collect()
    score = {r.doc_id: r.score for r in found}
    assert len(found) == len(tests) and all(score[i] >= 0.7 for i in range(len(forms))) and score[104] >= 0.7 and score[None] >= 0.7
    assert all(score[i] < 0.7 for i in (100, 101, 102, 103, 106)) and score[101] == score[102] == score[103]


def test_toxicity_without_a_machine(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], EMPTY)
    assert toxicity.train(docs, spark.createDataFrame([(1, 1), (None, 0), (2, None), (2, 7)], "doc_id long, toxic int")) is None
    assert {r.score for r in toxicity.scored(docs, None).collect()} == {0.0}
    assert toxicity.scored(docs.limit(0), None).count() == 0


def test_samples_are_bounded_and_repeatable(spark):
    rows = [(i, "many" if i % 3 else f"rare{i % 7}") for i in range(30_000)] + [(None, "none"), (5, None)]
    labelled = spark.createDataFrame(rows, "doc_id long, lang string").repartition(6)
    found = {lang: n for lang, n in bounded_sample(labelled, "lang", 50).groupBy("lang").count().collect()}
    assert found == {"many": 50, **{f"rare{k}": 50 for k in range(7)}, "none": 1}
    again = bounded_sample(labelled.repartition(3), "lang", 50)
    assert sorted(tuple(map(str, r)) for r in again.collect()) == sorted(tuple(map(str, r)) for r in bounded_sample(labelled, "lang", 50).collect())
    assert bounded_sample(labelled, "lang", 5, most_labels=2).select("lang").distinct().count() == 2


def test_stretches_hold_all_passages():
    text = b" ".join(b"w%d" % (i % 97) for i in range(48 * 500))
    found = quality.stretches(text)
    bins, passage, doc = quality.passages([text])
    every = quality.features(bins, passage, 0, len(doc))
    want = [every[np.arange(len(doc)) * 24 // len(doc) == k].mean(axis=0) for k in range(24)]
    assert found.shape == (24, quality.BINS) and np.allclose(found, want)
    assert quality.stretches(b"one passage").shape == (1, quality.BINS)


def thue_morse(n: int, swap: bool) -> str:
    return "".join("ab"[(bin(i).count("1") + swap) % 2] for i in range(n))


def test_long_words_and_one_id_with_two_texts(spark):
    first, second = thue_morse(2048, False), thue_morse(2048, True)
    rows = [(1, first), (2, second), (3, first + " "), (10, "one two three four five six"), (10, "seven eight nine ten eleven twelve"),
            (11, "ONE two three four five six"), (12, "seven eight nine ten eleven twelve"), (13, "w " * 60_000), (14, "w " * 60_001)]
    docs = spark.createDataFrame(rows, EMPTY).withColumn("component_id", F.lit("clash"))
    found = Counter((r.doc_id, r.component_id) for r in ngram_join.near_duplicates(docs).collect())
    assert found == Counter({(1, 1): 1, (2, 2): 1, (3, 1): 1, (10, 10): 2, (11, 10): 1, (12, 10): 1, (13, 13): 1, (14, 13): 1})
    kept = ngram_join.without_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == sorted((i, t) for i, t in rows if i in (1, 2, 10, 13))


def test_pseudonyms_of_long_texts(spark):
    n = 100_000
    runs = ["@" * n, "a@b" + ".c" * (n // 2), "a@b" + ".com" * (n // 4), "." * n, "1" * n, "1-" * (n // 2), "1." * (n // 2), "+1 " * (n // 3),
            "(0" * (n // 2), "A" * n, "a" * n, "DE89" + " 3704" * (n // 5), "1/" * (n // 2), "é@é." * (n // 4), "x" * n + "@example.com", "10.0.0.1 " * (n // 9)]
    docs = spark.createDataFrame([*enumerate(runs), (99, "jo@ex.com " * 2000)], EMPTY)
    found = {r.doc_id: r.text for r in pseudonyms.pseudonymise(docs, "k").collect()}
    assert len(found) == len(runs) + 1 and found[0] == runs[0] and found[1] == runs[1] and len(found[14]) == len(runs[14]) and found[14] != runs[14]
    assert len(set(found[99].split())) == 1 and "jo@" not in found[99]


def test_pieces_of_texts_without_spaces():
    encoder = pieces.PieceEncoder(pieces.model_path())
    rng = random.Random(9)
    parts = ["a", "b", "th", "e", "in", "ing", "tion", "er", "é", "ñ", "st", "中", "文", "\n", "😀", "0"]
    texts = ["a" * 5000, "ab" * 3000, "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(100_000))]
    texts += ["".join(rng.choices(parts, k=rng.randint(100, 600))) for _ in range(150)] + ["x " + "the" * 400 + " y"]
    for text, (ids, _) in zip(texts, encoder.encode(texts)):
        assert ids.tolist() == encoder.library.encode(text)
    symbols = np.array([encoder.symbols.setdefault(c, len(encoder.symbols)) for c in texts[2][:5000]], dtype=np.int64)
    n = len(symbols)
    following, before, rank = np.arange(1, n + 1), np.arange(-1, n - 1), np.full(n, pieces.NO_PAIR)
    rank[:-1] = encoder.rated(symbols[:-1], symbols[1:])[0]
    single, alive = encoder.one_by_one(symbols, following, before, rank, np.ones(n, dtype=bool))
    assert single[alive].tolist() == encoder.long_spans([texts[2][:5000]])[0].tolist()
