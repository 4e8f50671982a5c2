"""Toxic documents by a support vector machine over a subsequence string kernel.

The kernel of two strings counts the subsequences of ``ORDER`` letters that they share; an occurrence weighs less
with every letter it leaves out. The edge of a word counts as a letter, but not between single letters, as in s p a c e d
words, where it weighs little. Kernels are normalised, so a word with gaps or inserted characters still resembles the plain
word. A sentence is read through its words and pairs of neighbouring words; a word that repeats the one before adds nothing.

Training. Landmarks are words of distinct labelled sentences: those that tell the classes apart best,
and the most common of clean ones. By Nyström's method a word is its kernel values with the landmarks, times the inverse root
of their kernel matrix. A document's label speaks of its worst word: in each round, every sampled
document gives the word or pair that scores highest so far, whole texts being searched, and the machine is fitted
anew; those of clean documents stay for all rounds. Landmarks that certainly tell toxic sentences are examples themselves, plain,
spaced and with one character put in. The machine and the landmarks then fold into one weight per subsequence, so
scoring a text is one pass of table lookups. Sampled documents that the machine has not seen tell where the label begins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoplight.llm.common import bounded_sample, held_out, map_batches, mix, table, text_slices
from shoplight.session import prepare, stored

# Letters of a subsequence, and the letters that it may reach over.
ORDER, REACH = 4, 6
# Weight of an occurrence by the letters it leaves out, and of an edge between single letters.
SKIPPED, SPACED = (1.0, 0.8, 0.64), 0.9
# Counts as so many edges: the end of a sentence, which nothing crosses.
NEVER = 60
# Letters of a word at most; what is longer is cut.
LONGEST = 24
# Bytes of text that are scored together; what is worked on then stays in the processor's cache.
SLICE = 1 << 15
# Labelled documents of each class that are sampled, at most; landmarks of each kind; rounds. Of ``PARTS`` sampled documents
# one is kept for the threshold.
PER_CLASS, LANDMARKS, ROUNDS, PARTS = 3000, 192, 4, 4
LABEL_AT = 0.7
# What the certain landmarks weigh beside documents, a clean document called toxic beside a toxic one missed, and how fast scores rise.
SURE_SHARE, FALSE_ALARM, SLOPE = 0.2, 3.0, 4.0

# Strength, in standard deviations, from which a landmark is an example of the toxic class.
CERTAIN = 5.0

# Letters 1 to 26, whatever their case; digits and signs that stand for letters; 27 to 31 for other scripts; 32 for the edge of a word.
LETTERS, OTHERS, EDGE = 33, 27, 32
LOOK_ALIKE = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
INSIDE = 255
_SYMBOL = np.zeros(256, dtype=np.uint8)
_SYMBOL[np.arange(65, 91)] = _SYMBOL[np.arange(97, 123)] = np.arange(1, 27)
for _sign, _letter in LOOK_ALIKE.items():
    _SYMBOL[ord(_sign)] = ord(_letter) - 96
_SYMBOL[0x80:0xC0] = INSIDE
_SYMBOL[0xC0:] = OTHERS
_STOP = np.zeros(256, dtype=bool)
_STOP[[33, 46, 63]] = True
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True

PATTERNS = [(0, *rest) for rest in combinations(range(1, REACH), ORDER - 1)]
_CROSSING = np.where(np.arange(NEVER + 1) < NEVER, SPACED ** np.arange(NEVER + 1), 0).astype(np.float32)


def changes(values: np.ndarray) -> np.ndarray:
    """Whether each value differs from the one before; the first does."""
    found = np.ones(len(values), dtype=bool)
    np.not_equal(values[1:], values[:-1], out=found[1:])
    return found


def repeated(symbol: np.ndarray, apart: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Whether each letter lies in a word of several letters that is the same as the word before it."""
    if not len(symbol):
        return np.zeros(0, dtype=bool)
    starts = np.flatnonzero(changes(apart) | changes(text))
    sizes = np.diff(starts, append=len(symbol))
    place = np.arange(len(symbol)) - np.repeat(starts, sizes)
    name = np.add.reduceat(mix(place.astype(np.uint64) << np.uint64(8) | symbol), starts)
    same = np.zeros(len(starts), dtype=bool)
    same[1:] = (name[1:] == name[:-1]) & (sizes[1:] == sizes[:-1]) & (sizes[1:] > 1) & (text[starts[1:]] == text[starts[:-1]])
    return np.repeat(same, sizes)


@dataclass
class Letters:
    """The letters of some texts one after another."""

    symbol: np.ndarray
    # Edges between single letters up to each letter, and the sentence and text of each.
    units: np.ndarray
    sentence: np.ndarray
    text: np.ndarray

    @staticmethod
    def of(texts: list[bytes]) -> Letters:
        raw = np.frombuffer(b"\n".join([*texts, b""]), dtype=np.uint8)
        symbol = _SYMBOL[raw]
        others = np.flatnonzero(raw >= 0xC0)
        # Of two bytes, upper and lower case mostly differ in a bit that is not looked at.
        symbol[others] = OTHERS + (raw[others + 1] & 0x1F) % (EDGE - OTHERS)
        at = np.flatnonzero((symbol > 0) & (symbol < INSIDE))
        text = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) + 1 for t in texts])
        apart = np.cumsum(symbol == 0, dtype=np.int32)
        at = at[~repeated(symbol[at], apart[at], text[at])]
        if not len(at):
            none = np.zeros(0, dtype=np.int32)
            return Letters(none, none, none, none)
        ends = raw == 10
        ends[:-1] |= _STOP[raw[:-1]] & _BLANK[raw[1:]]
        sentence, text, apart = np.cumsum(ends, dtype=np.int32)[at], text[at], apart[at]
        new = changes(sentence)
        starts = np.flatnonzero(new | changes(apart))
        single = np.diff(starts, append=len(at)) == 1
        spaced = single & ~new[starts]
        spaced[1:] &= single[:-1]
        cost = np.zeros(len(at), dtype=np.int32)
        cost[starts[spaced]] = 1
        # An edge stands before every other word, and after the last of a sentence.
        edges = starts[~spaced]
        inside = np.arange(len(at)) - np.repeat(edges, np.diff(edges, append=len(at)))
        edges = np.flatnonzero(inside % LONGEST == 0)
        last = np.append(np.flatnonzero(new[1:]), len(at) - 1)
        put = np.zeros(len(at) + 1, dtype=np.int32)
        put[edges] += 1
        put[last + 1] += 1
        place = np.arange(len(at)) + np.cumsum(put[:-1])
        found = []
        for values, before, after in ((symbol[at], EDGE, EDGE), (sentence, sentence[edges], sentence[last]), (text, text[edges], text[last]), (cost, 0, 0)):
            whole = np.empty(len(at) + len(edges) + len(last), dtype=np.int32)
            whole[place], whole[place[edges] - 1], whole[place[last] + 1] = values, before, after
            found.append(whole)
        letters, sentence, text, cost = found
        cost[changes(sentence)] = NEVER
        return Letters(letters, np.cumsum(cost, dtype=np.int32), sentence, text)

    def subsequences(self) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """For each pattern of offsets: the codes and weights of the letters that can begin it, and its last offset."""
        n = len(self.symbol)
        digits = [self.symbol * np.int32(LETTERS**k) for k in range(ORDER - 1, -1, -1)]
        crossing: dict[int, np.ndarray] = {}
        for offsets in PATTERNS:
            reach = offsets[-1]
            if (m := n - reach) <= 0:
                continue
            code = digits[0][:m] + digits[1][offsets[1] : offsets[1] + m]
            for k in range(2, ORDER):
                code += digits[k][offsets[k] : offsets[k] + m]
            if reach not in crossing:
                crossing[reach] = _CROSSING[np.minimum(self.units[reach:] - self.units[:m], NEVER)]
            yield code, crossing[reach] * np.float32(SKIPPED[reach - ORDER + 1]), reach


def highest(letters: Letters, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The normalised sum of weights of each word and each pair of neighbours; their first letters and last edges."""
    n = len(letters.symbol)
    edges = np.flatnonzero(letters.symbol == EDGE)
    # The edges after each letter: of its word and of the next.
    before = np.cumsum(letters.symbol == EDGE)
    after = np.append(edges, [n + REACH] * 2)[before]
    left = np.minimum(after - np.arange(n), REACH).astype(np.int8)
    inside, squares, over, over_squares = (np.zeros(n, dtype=np.float32) for _ in range(4))
    for code, weight, reach in letters.subsequences():
        m = len(code)
        value = whole[code]
        value *= weight
        weight *= weight
        own = left[:m] >= reach
        over[:m] += value
        over_squares[:m] += weight
        value *= own
        weight *= own
        inside[:m] += value
        squares[:m] += weight
    over -= inside
    over_squares -= squares
    word = edges[np.append(np.diff(letters.sentence[edges]) == 0, False)]  # the edges that begin a word
    if not len(word):
        return np.zeros(0), word, word
    sums = [np.add.reduceat(x.astype(np.float64), word) for x in (inside, squares, over, over_squares)]
    end = after[word]
    pair = np.flatnonzero(np.append(end[:-1] == word[1:], False))
    both = [sums[0][pair] + sums[2][pair] + sums[0][pair + 1], sums[1][pair] + sums[3][pair] + sums[1][pair + 1]]
    value = np.concatenate([sums[0] / np.sqrt(np.maximum(sums[1], 1e-9)), both[0] / np.sqrt(np.maximum(both[1], 1e-9))])
    return value, np.concatenate([word, word[pair]]), np.concatenate([end, end[pair + 1]])


@dataclass
class Machine:
    """The weight of each subsequence, and the slope and offset that make a score of a sum."""

    codes: np.ndarray
    weights: np.ndarray
    slope: float = 1.0
    offset: float = 0.0

    def table(self) -> np.ndarray:
        whole = np.zeros(LETTERS**ORDER, dtype=np.float32)
        whole[self.codes] = self.weights
        return whole

    def sums(self, texts: list[bytes], whole: np.ndarray) -> tuple[np.ndarray, list[tuple[bytes, bytes]]]:
        """The highest sum of each text's words and pairs, 0 without letters, and the letters and edge units of that word or pair."""
        letters = Letters.of(texts)
        best, shown = np.zeros(len(texts)), [(b"", b"")] * len(texts)
        value, begin, end = highest(letters, whole) if len(letters.symbol) else (np.zeros(0), np.zeros(0, int), np.zeros(0, int))
        if not len(value):
            return best, shown
        owner = letters.text[begin]
        # The highest of each text, the first of equal ones.
        top = np.full(len(texts), -np.inf)
        np.maximum.at(top, owner, value)
        hits = np.flatnonzero(value == top[owner])
        hits = hits[np.lexsort((begin[hits], owner[hits]))]
        for k in hits[changes(owner[hits])].tolist():
            span = slice(begin[k], end[k] + 1)
            cost = np.diff(letters.units[span], prepend=letters.units[begin[k]]).astype(np.uint8)
            best[owner[k]], shown[owner[k]] = value[k], (letters.symbol[span].astype(np.uint8).tobytes(), cost.tobytes())
        return best, shown

    def score(self, sums: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * sums + self.offset, -30, 30)))


def features(strings: list[tuple[bytes, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner, code and weight of the subsequences of strings given by letters and edge units; each string has norm 1."""
    owner, codes, weights = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
    for i, (symbol, cost) in enumerate(strings):
        none = np.zeros(len(symbol), dtype=np.int64)
        one = Letters(np.frombuffer(symbol, np.uint8).astype(np.int32), np.cumsum(np.frombuffer(cost, np.uint8).astype(np.int64)), none, none)
        for code, weight, _ in one.subsequences():
            owner.append(np.full(len(code), i))
            codes.append(code.astype(np.int64))
            weights.append(weight.astype(np.float64))
    owner, codes, weights = np.concatenate(owner), np.concatenate(codes), np.concatenate(weights)
    norm = np.sqrt(np.bincount(owner, weights**2, minlength=len(strings)))
    return owner, codes, weights / np.maximum(norm, 1e-9)[owner]


def kernel(strings: list[tuple[bytes, bytes]], codes: np.ndarray, dense: np.ndarray) -> np.ndarray:
    """Kernel values of strings with the landmarks, which are given by their codes and a column of weights each."""
    found = np.zeros((len(strings), dense.shape[1]))
    for first in range(0, len(strings), 200):  # some strings at a time, as each of their subsequences needs a row
        owner, code, weight = features(strings[first : first + 200])
        at = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
        known = np.flatnonzero(codes[at] == code)
        if len(known):
            begin = np.flatnonzero(np.diff(owner[known], prepend=-1))
            found[first + owner[known[begin]]] = np.add.reduceat(weight[known, None] * dense[at[known]], begin)
    return found


def support_vectors(x: np.ndarray, sign: np.ndarray, share: np.ndarray, slack: float = 1e5, turns: int = 1000) -> np.ndarray:
    """The weights of a linear machine with an offset and squared hinge loss, by accelerated gradient steps; ``share`` weighs the rows."""
    z = np.c_[x, np.ones(len(x))]
    steepest = np.ones(z.shape[1])
    for _ in range(30):  # the largest curvature, by power iteration
        steepest = z.T @ (share * (z @ steepest))
        curvature = np.linalg.norm(steepest)
        steepest /= max(curvature, 1e-300)
    shrink = np.append(np.full(x.shape[1], 1 / slack), 0.0)
    step = 1 / (2.2 * curvature + 1 / slack)
    w = ahead = np.zeros(z.shape[1])
    t = 1.0
    for _ in range(turns):
        lack = np.maximum(0, 1 - sign * (z @ ahead)) * sign * share
        new = ahead - step * (shrink * ahead - 2 * z.T @ lack)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead = new + (t - 1) / t_new * (new - w)
        w, t = new, t_new
    return w[:-1]


def threshold(sums: np.ndarray, labels: np.ndarray) -> float:
    """Where the share of toxic documents above, less ``FALSE_ALARM`` times that of clean ones, is highest."""
    toxic, clean = np.sort(sums[labels == 1]), np.sort(sums[labels == 0])
    found = np.unique(sums)
    between = np.append((found[1:] + found[:-1]) / 2, found[-1] + 1)
    gain = FALSE_ALARM * np.searchsorted(clean, between) / len(clean) - np.searchsorted(toxic, between) / len(toxic)
    return float(between[gain >= gain.max() - 1e-9].mean())


def landmark_words(sample: DataFrame, most: int) -> list[tuple[str, float]]:
    """Words of distinct sentences with the strength by which they tell toxic ones: the strongest, and the most common of clean ones at 0.

    Equal sentences count once, and one that a clean document has counts as clean; so copies of a document add nothing.
    """
    sentences = (sample.select("label", F.explode(F.split(F.lower("text"), r"[.!?]\s|\n")).alias("said"))
                 .select("label", F.array_distinct(F.split(F.trim(F.regexp_replace("said", r"[^\p{L}]+", " ")), " ")).alias("words"))
                 .groupBy("words").agg(F.min("label").alias("label")))
    words = (sentences.select("label", F.explode("words").alias("word")).filter(F.length("word").between(ORDER, 24))
             .groupBy("word").agg(F.sum("label").alias("toxic"), F.count("*").alias("n")))
    totals = sentences.agg(F.sum("label").alias("all_toxic"), F.count("*").alias("all_n"))
    share, clean = F.col("n") / F.col("all_n"), F.col("n") - F.col("toxic")
    rated = words.join(F.broadcast(totals)).filter("all_toxic > 0 AND all_toxic < all_n").withColumn(
        "strength", (F.col("toxic") / F.col("all_toxic") - clean / (F.col("all_n") - F.col("all_toxic")))
        / F.sqrt(share * (1 - share) * (1 / F.col("all_toxic") + 1 / (F.col("all_n") - F.col("all_toxic"))) + 1e-12))
    strong = rated.filter("toxic > 1 AND strength > 0").orderBy(F.desc("strength"), "word").limit(most).select("word", "strength")
    common = rated.orderBy(F.desc(F.col("n") - F.col("toxic")), "word").limit(most).select("word", F.lit(0.0).alias("strength"))
    found: dict[str, float] = {}
    for word, strength in [*strong.collect(), *common.collect()]:
        found.setdefault(word, strength)
    return list(found.items())


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, doc_id: str = "doc_id", text: str = "text",
          label: str = "toxic") -> Machine | None:
    """A machine from labelled documents that are not held out; None unless both classes occur and some word tells them apart.

    At most ``per_class`` documents of each class, with all their sentences. Labels other than 0 and 1 are ignored; of several
    labels of one document the largest counts. The driver receives the landmarks and one word or pair of each sampled document and round.
    """
    known = (labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("label"))
             .filter(F.col("label").isin(0, 1) & ~held_out("doc_id")).groupBy("doc_id").agg(F.max("label").alias("label")))
    chosen = F.broadcast(bounded_sample(known, "label", per_class))
    spare = F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(PARTS)) == 0
    whole = stored(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).filter("text IS NOT NULL")
                   .join(chosen, "doc_id").select("label", "text", spare.alias("spare")), "toxicity-sample")
    sample = whole.filter("NOT spare")
    words = landmark_words(sample, LANDMARKS)
    strings = [variants(w)[0] for w, _ in words]
    owner, code, weight = features(strings)
    if not len(code) or not any(s > 0 for _, s in words):
        return None
    codes = np.unique(code)
    dense = np.zeros((len(codes), len(words)))
    np.add.at(dense, (np.searchsorted(codes, code), owner), weight)
    values, vectors = np.linalg.eigh(dense.T @ dense)
    root = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 0) + 1e-3)) @ vectors.T
    alpha = np.array([float(s > 0) for _, s in words])
    sure = [(v, 1 / len(all_of)) for w, s in words if s >= CERTAIN for all_of in [variants(w)] for v in all_of]
    against = sorted({variants(w)[0] for w, s in words if s == 0})
    machine = Machine(codes, (dense @ alpha).astype(np.float32))
    rated: dict[tuple[bytes, bytes], np.ndarray] = {}
    for _ in range(ROUNDS):
        rows = worst_words(sample, machine)
        toxic = [(r["letters"], r["bounds"]) for r in rows if r["label"] == 1]
        against = sorted({*against, *((r["letters"], r["bounds"]) for r in rows if r["label"] == 0)})
        if not toxic or not against:
            return None
        certain = np.array([weight for _, weight in sure])
        of_documents = 0.5 * (1 - SURE_SHARE) if sure else 0.5
        share = np.concatenate([np.full(len(toxic), of_documents / len(toxic)), certain * (0.5 - of_documents) / max(certain.sum(), 1e-9),
                                np.full(len(against), 0.5 / len(against))])
        every = [*toxic, *(v for v, _ in sure), *against]
        if fresh := list({v for v in every if v not in rated}):
            rated.update(zip(fresh, (kernel(fresh, codes, dense) @ root).astype(np.float32)))
        x = np.stack([rated[v] for v in every]).astype(float)
        w = support_vectors(x, np.repeat([1.0, -1.0], [len(toxic) + len(sure), len(against)]), share)
        machine = Machine(codes, (dense @ (root @ w)).astype(np.float32))
    rows = worst_words(whole.filter("spare"), machine)
    if len({r["label"] for r in rows}) < 2:
        rows = worst_words(whole, machine)
    begin = threshold(np.array([r["best"] for r in rows]), np.array([r["label"] for r in rows]))
    return Machine(codes, machine.weights, SLOPE, np.log(LABEL_AT / (1 - LABEL_AT)) - SLOPE * begin)


def variants(word: str) -> list[tuple[bytes, bytes]]:
    """A word between edges; the same spaced; with an edge or a letter put in at each place."""
    symbol, _ = spelled(word)
    edge, letter = bytes([EDGE]), bytes([ord("x") - 96])
    plain = [symbol, *(symbol[:k] + one + symbol[k:] for k in range(1, len(symbol)) for one in (edge, letter))]
    return [*((edge + p + edge, bytes(len(p) + 2)) for p in plain), (edge + symbol + edge, b"\0\0" + b"\1" * (len(symbol) - 1) + b"\0")]


def spelled(word: str) -> tuple[bytes, bytes]:
    """Letters of one word without its edges, and their edge units."""
    symbol = Letters.of([word.encode()]).symbol.astype(np.uint8).tobytes().strip(bytes([EDGE]))
    return symbol, bytes(len(symbol))


def worst_words(sample: DataFrame, machine: Machine) -> list:
    """Of every sampled document its label, its highest sum and that word or pair; in a fixed order."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = machine.table()
        for batch in batches:
            for marks, texts in text_slices(batch, "label", "text", SLICE):
                best, shown = machine.sums(texts, whole)
                yield pa.RecordBatch.from_pydict({
                    "label": pa.array(marks, pa.int32()), "best": pa.array(best, pa.float64()),
                    "letters": pa.array([s for s, _ in shown], pa.binary()), "bounds": pa.array([c for _, c in shown], pa.binary())})

    rows = map_batches(sample, run, "label int, best double, letters binary, bounds binary").collect()
    return sorted(rows, key=lambda r: (r["label"], r["best"], bytes(r["letters"]), bytes(r["bounds"])))


def scored(docs: DataFrame, machine: Machine | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and score of every row.

    A null text counts as empty; a text without letters has the score of the sum 0. Without a machine every score is
    0. Repeated rows give repeated results, a null id stays null, an empty table gives an empty table, other columns are not read.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = machine.table() if machine else None
        for batch in batches:
            for keys, texts in text_slices(batch, "doc_id", "text", SLICE):
                found = machine.score(machine.sums(texts, whole)[0]) if machine else np.zeros(len(texts))
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(keys, pa.int64()), "score": pa.array(found, pa.float64())})

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return map_batches(rows, run, "doc_id long, score double")


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity score of every document."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    found = scored(docs, train(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= LABEL_AT).cast("int").alias("predicted"))
