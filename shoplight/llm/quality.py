"""Document quality by attention over passages.

A document is a bag of passages of ``PASSAGE_WORDS`` words. Each passage is encoded (hashed byte
pairs, one learned layer), gated attention learned from document labels alone weighs the passages,
and the weighted sum is scored. The network is fitted with numpy on a bounded sample of labelled
documents; scoring reads every passage of every text in a running sum, so a text of any length
needs little memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoplight.llm.common import bounded_sample, held_out, map_batches, table, text_slices
from shoplight.session import prepare

PASSAGE_WORDS = 48
BINS, HIDDEN, GATE = 512, 24, 12
# Labelled documents of each class that the network is fitted on, at most. Scoring has no such bound.
PER_CLASS = 800
# A sampled document of more passages is learned from as so many stretches of them; a stretch has the mean features of all its passages.
STRETCHES = 24
EPOCHS, BATCH, RATE, SHRINK = 25, 64, 0.01, 1e-4
# Passages whose features are held at once.
BLOCK = 2048

_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


def passages(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bin of every byte pair, its passage, and the document of each passage.

    Every document has one passage at least; one without words has a passage of its spaces.
    """
    padded = [b" " + t + b" " for t in texts]
    raw = np.frombuffer(b"".join([*padded, b" "]), dtype=np.uint8)
    sizes = np.array([len(p) for p in padded])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    space = _IS_SPACE[raw[:-1]]
    word_start = np.zeros(len(space), dtype=np.int64)
    word_start[1:] = space[:-1] & ~space[1:]
    words = np.cumsum(word_start)
    inside = np.maximum(words - np.repeat(words[starts], sizes) - 1, 0) // PASSAGE_WORDS
    doc = np.repeat(np.arange(len(texts)), sizes)
    change = (np.diff(inside, prepend=-1) != 0) | (np.diff(doc, prepend=-1) != 0)
    passage = np.cumsum(change) - 1
    pairs = raw[:-1].astype(np.uint32) << 8 | raw[1:]
    return ((pairs * np.uint32(2654435761)) >> np.uint32(23)).astype(np.int64), passage, doc[change]


def features(bins: np.ndarray, passage: np.ndarray, first: int, last: int) -> np.ndarray:
    """Square roots of the bins' shares of passages ``first`` to ``last``, exclusive."""
    a, b = np.searchsorted(passage, [first, last])
    counts = np.bincount((passage[a:b] - first) * BINS + bins[a:b], minlength=(last - first) * BINS).reshape(-1, BINS)
    return np.sqrt(counts / np.maximum(counts.sum(axis=1, keepdims=True), 1))


def stretches(text: bytes) -> np.ndarray:
    """The features of all passages of a text, as means over at most ``STRETCHES`` stretches of about equal length."""
    bins, passage, doc = passages([text])
    n = len(doc)
    count = min(n, STRETCHES)
    stretch = np.arange(n) * count // n
    sums = np.zeros((count, BINS))
    for first in range(0, n, BLOCK):
        last = min(first + BLOCK, n)
        begin = np.flatnonzero(np.diff(stretch[first:last], prepend=-1))
        sums[stretch[first + begin]] += np.add.reduceat(features(bins, passage, first, last), begin)
    return sums / np.bincount(stretch)[:, None]


@dataclass
class Network:
    """The weights of encoder, gated attention and score."""

    weights: dict[str, np.ndarray]

    def parts(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each passage's code and its attention before normalisation."""
        w = self.weights
        code = np.tanh(x @ w["encode"] + w["encode0"])
        return code, (np.tanh(code @ w["attend"]) / (1 + np.exp(-np.clip(code @ w["gate"], -30, 30)))) @ w["weigh"]

    def score(self, texts: list[bytes]) -> np.ndarray:
        """The chance of label 1 of each text, in blocks of passages.

        Attention is bounded by the weights' size, so its exponentials add up without a shift.
        """
        bins, passage, doc = passages(texts)
        top = np.zeros((len(texts), self.weights["out"].shape[0]))
        total = np.zeros(len(texts))
        highest = float(np.abs(self.weights["weigh"]).sum())
        for first in range(0, len(doc), BLOCK):
            last = min(first + BLOCK, len(doc))
            code, attention = self.parts(features(bins, passage, first, last))
            share = np.exp(attention - highest)
            np.add.at(total, doc[first:last], share)
            np.add.at(top, doc[first:last], share[:, None] * code)
        z = top / total[:, None]
        return 1 / (1 + np.exp(-np.clip(z @ self.weights["out"] + self.weights["out0"], -30, 30)))


def fit(bags: list[np.ndarray], labels: np.ndarray, seed: int = 7) -> Network:
    """Adam on the logistic loss, both classes weighted alike; gradients by hand. Bags are widened as they are used."""
    rng = np.random.default_rng(seed)
    w = {
        "encode": rng.normal(0, 2 / np.sqrt(BINS), (BINS, HIDDEN)), "encode0": np.zeros(HIDDEN),
        "attend": rng.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, GATE)), "gate": rng.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, GATE)),
        "weigh": rng.normal(0, 1 / np.sqrt(GATE), GATE), "out": rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), "out0": np.zeros(1),
    }
    mean = {k: np.zeros_like(v) for k, v in w.items()}
    square = {k: np.zeros_like(v) for k, v in w.items()}
    class_weight = np.where(labels == 1, 0.5 / max((labels == 1).mean(), 1e-9), 0.5 / max((labels == 0).mean(), 1e-9))
    turn = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), BATCH):
            some = order[at : at + BATCH]
            x = np.concatenate([bags[i] for i in some]).astype(float)
            sizes = np.array([len(bags[i]) for i in some])
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            owner = np.repeat(np.arange(len(some)), sizes)
            code = np.tanh(x @ w["encode"] + w["encode0"])
            left, right = np.tanh(code @ w["attend"]), 1 / (1 + np.exp(-code @ w["gate"]))
            attention = (left * right) @ w["weigh"]
            share = np.exp(attention - np.maximum.reduceat(attention, starts)[owner])
            share /= np.add.reduceat(share, starts)[owner]
            z = np.add.reduceat(share[:, None] * code, starts)
            chance = 1 / (1 + np.exp(-np.clip(z @ w["out"] + w["out0"], -30, 30)))
            error = (chance - labels[some]) * class_weight[some] / len(some)
            g = {"out": z.T @ error, "out0": np.array([error.sum()])}
            dz = error[:, None] * w["out"]
            d_share = (dz[owner] * code).sum(axis=1)
            d_attention = share * (d_share - np.add.reduceat(share * d_share, starts)[owner])
            g["weigh"] = (left * right).T @ d_attention
            d_mixed = d_attention[:, None] * w["weigh"]
            d_left, d_right = d_mixed * right * (1 - left**2), d_mixed * left * right * (1 - right)
            g["attend"], g["gate"] = code.T @ d_left, code.T @ d_right
            d_code = (share[:, None] * dz[owner] + d_left @ w["attend"].T + d_right @ w["gate"].T) * (1 - code**2)
            g["encode"], g["encode0"] = x.T @ d_code, d_code.sum(axis=0)
            turn += 1
            for k in w:
                grad = g[k] + SHRINK * w[k]
                mean[k] = 0.9 * mean[k] + 0.1 * grad
                square[k] = 0.999 * square[k] + 0.001 * grad**2
                w[k] = w[k] - RATE * (mean[k] / (1 - 0.9**turn)) / (np.sqrt(square[k] / (1 - 0.999**turn)) + 1e-8)
    return Network(w)


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, doc_id: str = "doc_id", text: str = "text",
          label: str = "quality") -> Network | None:
    """A network from labelled documents that are not held out; None unless both classes occur.

    At most ``per_class`` documents of each class, with all their passages, whose features are made and, in long texts,
    averaged over stretches in the tasks. Labels other than 0 and 1 are ignored; of several labels of one document the largest counts.
    """
    known = (labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("label"))
             .filter(F.col("label").isin(0, 1) & ~held_out("doc_id")).groupBy("doc_id").agg(F.max("label").alias("label")))
    chosen = F.broadcast(bounded_sample(known, "label", per_class))
    sample = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).join(chosen, "doc_id")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for marks, texts in text_slices(batch, "label", "text", 1 << 20):
                bags = []
                for one in texts:
                    bags.append(stretches(one).astype("<f2").tobytes())
                yield pa.RecordBatch.from_pydict({"label": pa.array(marks, pa.int32()), "bag": pa.array(bags, pa.binary())})

    rows = map_batches(sample.select("label", "text"), encode, "label int, bag binary").collect()
    rows.sort(key=lambda r: (r["label"], bytes(r["bag"])))
    marks = np.array([r["label"] for r in rows])
    if len(set(marks.tolist())) < 2:
        return None
    return fit([np.frombuffer(r["bag"], dtype="<f2").reshape(-1, BINS) for r in rows], marks)


def scored(docs: DataFrame, network: Network | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and score of every row.

    A null text counts as empty; an empty text is one passage without words and is scored too.
    Without a network every score is 0.5. Repeated rows give repeated results, a null id stays
    null, an empty table gives an empty table, other columns are not read.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, texts in text_slices(batch, "doc_id", "text", 1 << 20):
                found = np.full(len(texts), 0.5) if network is None else network.score(texts)
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(keys, pa.int64()), "score": pa.array(found, pa.float64())})

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return map_batches(rows, run, "doc_id long, score double")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of every document."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    found = scored(docs, train(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
