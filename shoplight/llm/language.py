"""Language identification in two steps.

A text's letter trigrams are hashed into ``BINS`` frequencies. Linear classifiers first choose the
language family; within it, one linear support vector machine per pair of languages votes. All of
them are fitted on a bounded sample of labelled documents. Scores are sums of weights over the
trigrams of the whole text, so a document of any length needs one pass and little memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shoplight.llm.common import bounded_sample, free_name, held_out, map_batches, table, text_slices
from shoplight.session import prepare

BINS = 4096
# Labelled documents of each language that the classifiers are fitted on, at most.
PER_LANGUAGE = 400
UNDETERMINED = "und"

# Families by language code (fixed values). A language that is not listed is a family of its own.
FAMILIES = {
    "germanic": ["af", "da", "de", "en", "fy", "is", "lb", "nb", "nl", "nn", "no", "sv", "yi"],
    "romance": ["ca", "es", "fr", "gl", "it", "la", "oc", "pt", "ro"],
    "slavic": ["be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"],
    "celtic": ["br", "cy", "ga", "gd"],
    "baltic": ["lt", "lv"],
    "uralic": ["et", "fi", "hu"],
    "turkic": ["az", "kk", "ky", "tk", "tr", "tt", "uz"],
    "indic": ["bn", "gu", "hi", "mr", "ne", "pa", "si", "ur"],
    "semitic": ["am", "ar", "he", "mt"],
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes}

# ASCII letters in lower case, bytes of other letters as they are, everything else a space.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def trigram_bins(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The bin of every trigram of the texts in turn, and where each text's begin.

    Each text stands between spaces, so none of its trigrams depends on the texts beside it.
    """
    padded = [b"  " + t.translate(_LETTERS) + b"  " for t in texts]
    raw = np.frombuffer(b"".join([*padded, b"  "]), dtype=np.uint8).astype(np.uint32)
    codes = raw[:-2] << 16 | raw[1:-1] << 8 | raw[2:]
    starts = np.concatenate([[0], np.cumsum([len(p) for p in padded])[:-1]])
    return ((codes * np.uint32(2654435761)) >> np.uint32(20)).astype(np.int64), starts.astype(np.int64)


def frequencies(bins: np.ndarray, starts: np.ndarray) -> np.ndarray:
    ends = np.append(starts[1:], len(bins))
    return np.stack([np.bincount(bins[a:b], minlength=BINS) / (b - a) for a, b in zip(starts, ends)])


@dataclass
class Machines:
    """Weights (one column per machine) and offsets of linear machines over trigram frequencies."""

    languages: list[str]
    families: list[str]
    family_weights: np.ndarray
    family_offsets: np.ndarray
    pairs: list[tuple[int, int]]
    pair_weights: np.ndarray
    pair_offsets: np.ndarray

    def predict(self, texts: list[bytes]) -> tuple[list[str], list[float]]:
        bins, starts = trigram_bins(texts)
        lengths = np.diff(np.append(starts, len(bins)))[:, None]
        weights = np.hstack([self.family_weights, self.pair_weights])
        means = np.stack([np.add.reduceat(w[bins], starts) for w in weights.T], axis=1) / lengths
        margins = means + np.concatenate([self.family_offsets, self.pair_offsets])
        family_margins, pair_margins = margins[:, : len(self.families)], margins[:, len(self.families) :]
        likely = np.exp(2 * (family_margins - family_margins.max(axis=1, keepdims=True)))
        likely /= likely.sum(axis=1, keepdims=True)
        family = family_margins.argmax(axis=1)
        wins = np.zeros((len(texts), len(self.languages)))
        rivals = np.zeros(len(self.languages))
        for (a, b), margin in zip(self.pairs, pair_margins.T):
            chance = 1 / (1 + np.exp(np.clip(-2 * margin, -50, 50)))
            wins[:, a] += chance
            wins[:, b] += 1 - chance
            rivals[a] += 1
            rivals[b] += 1
        # The mean chance against the family's other languages; 1 when there are none.
        wins = np.where(rivals > 0, wins / np.maximum(rivals, 1), 1.0)
        own = np.array([self.families.index(FAMILY_OF.get(x, x)) for x in self.languages])
        wins = np.where(own == family[:, None], wins, -1.0)
        best = wins.argmax(axis=1)
        rows = np.arange(len(texts))
        return [self.languages[b] for b in best], (wins[rows, best] * likely[rows, family]).tolist()


def linear_machine(x: np.ndarray, sign: np.ndarray, turns: int = 150, slack: float = 50.0) -> tuple[np.ndarray, float]:
    """A linear support vector machine with squared hinge loss, both classes weighted alike.

    Full-batch accelerated gradient descent; the data are centred and scaled, and the result is
    given for the data as they were.
    """
    if len(set(sign.tolist())) < 2:
        return np.zeros(x.shape[1]), float(sign[0]) if len(sign) else 0.0
    # One copy of the data, in single precision; sums over rows are in double.
    middle = x.mean(axis=0, dtype=float)
    z = x - middle.astype(x.dtype)
    scale = 1 / max(np.sqrt(np.einsum("ij,ij->", z, z, dtype=float) / len(z)), 1e-12)
    z *= x.dtype.type(scale)
    share = np.where(sign > 0, 0.5 / (sign > 0).sum(), 0.5 / (sign < 0).sum())
    w, b = np.zeros(x.shape[1]), 0.0
    ahead, ahead_b, t = w, b, 1.0
    steepest = np.ones(x.shape[1])
    for _ in range(20):  # the largest curvature, by power iteration
        steepest = z.T @ (share * (z @ steepest.astype(z.dtype))).astype(z.dtype)
        curvature = np.linalg.norm(steepest)
        steepest /= max(curvature, 1e-300)
    step = 1 / (1 + 2 * slack * (1.2 * curvature + 1))
    for _ in range(turns):
        lack = np.maximum(0, 1 - sign * (z @ ahead.astype(z.dtype) + ahead_b)) * sign * share
        new, new_b = ahead - step * (ahead - 2 * slack * (z.T @ lack.astype(z.dtype))), ahead_b + step * 2 * slack * lack.sum()
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, ahead_b = new + (t - 1) / t_new * (new - w), new_b + (t - 1) / t_new * (new_b - b)
        w, b, t = new, new_b, t_new
    return w * scale, float(b - (w * scale) @ middle)


def fit(x: np.ndarray, labels: list[str]) -> Machines:
    """Machines from frequencies and languages; the labels are the only languages it can predict."""
    languages = sorted(set(labels))
    families = sorted({FAMILY_OF.get(x, x) for x in languages})
    of = np.array([families.index(FAMILY_OF.get(x, x)) for x in labels])
    lang = np.array([languages.index(x) for x in labels])
    family_fits = [linear_machine(x, np.where(of == k, 1.0, -1.0)) for k in range(len(families))]
    pairs = [(a, b) for a, b in combinations(range(len(languages)), 2)
             if FAMILY_OF.get(languages[a], languages[a]) == FAMILY_OF.get(languages[b], languages[b])]
    pair_fits = []
    for a, b in pairs:
        chosen = (lang == a) | (lang == b)
        pair_fits.append(linear_machine(x[chosen], np.where(lang[chosen] == a, 1.0, -1.0)))
    stack = lambda fits: (np.stack([w for w, _ in fits], axis=1) if fits else np.zeros((BINS, 0)), np.array([b for _, b in fits]))
    return Machines(languages, families, *stack(family_fits), pairs, *stack(pair_fits))


def has_letter(text: str) -> Column:
    return F.coalesce(F.col(text).cast("string").rlike(r"\p{L}"), F.lit(False))


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Machines | None:
    """Machines from documents that are not held out and whose language is known; None when there are none.

    The sample has at most ``per_language`` documents of each language. Their trigram frequencies are
    made in the tasks, so the driver receives ``BINS`` numbers per document, however long its text.
    """
    usable = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).filter(
        ~held_out("doc_id") & F.col("lang").isNotNull() & has_letter("text"))
    chosen = bounded_sample(usable.select("doc_id", "lang"), "lang", per_language).select("doc_id").distinct()
    sample = usable.join(F.broadcast(chosen), "doc_id", "left_semi")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for langs, texts in text_slices(batch, "lang", "text"):
                for lang_of, one in zip(langs, texts):
                    x = frequencies(*trigram_bins([one]))[0].astype("<f4").tobytes()
                    yield pa.RecordBatch.from_pydict({"lang": pa.array([lang_of]), "x": pa.array([x], pa.binary())})

    rows = map_batches(sample.select("lang", "text"), count, "lang string, x binary").collect()
    if not rows:
        return None
    rows.sort(key=lambda r: (r["lang"], bytes(r["x"])))
    labels = [r["lang"] for r in rows]
    x = np.frombuffer(b"".join(r["x"] for r in rows), dtype="<f4").reshape(len(rows), BINS)
    del rows
    return fit(x, labels)


def identify(docs: DataFrame, machines: Machines | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred and score of every row.

    Text that is null or has no letter is ``und`` with score 0; so is every text when there was
    nothing to learn from. Repeated rows give repeated results, a null id stays null, an empty
    table gives an empty table, other columns are not read.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = list(range(batch.num_rows))
            numbered = batch.append_column("place", pa.array(places, pa.int64()))
            langs, scores = [UNDETERMINED] * batch.num_rows, [0.0] * batch.num_rows
            letters = batch.column("letters").to_pylist()
            if machines is not None:
                for some, texts in text_slices(numbered, "place", "text", 1 << 20):
                    kept = [(p, t) for p, t in zip(some, texts) if letters[p]]
                    if kept:
                        for (p, _), found, score in zip(kept, *machines.predict([t for _, t in kept])):
                            langs[p], scores[p] = found, score
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "lang_pred": pa.array(langs), "score": pa.array(scores, pa.float64())})

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), has_letter(text).alias("letters"))
    return map_batches(rows, run, "doc_id long, lang_pred string, score double")


def with_language(docs: DataFrame, machines: Machines | None, text: str = "text") -> tuple[DataFrame, str]:
    """``docs`` with its predicted language in one more column, and that column's name; no row moves."""
    name, flag, kept_columns = free_name(docs, "lang_pred"), free_name(docs, "has_letter"), list(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbered = pa.RecordBatch.from_arrays(
                [pa.array(range(batch.num_rows), pa.int64()), batch.column(batch.schema.get_field_index(text))], names=["place", "text"])
            langs = [UNDETERMINED] * batch.num_rows
            letters = batch.column(batch.schema.get_field_index(flag)).to_pylist()
            for some, texts in text_slices(numbered, "place", "text", 1 << 20):
                kept = [(p, t) for p, t in zip(some, texts) if letters[p]]
                if kept and machines is not None:
                    for (p, _), found in zip(kept, machines.predict([t for _, t in kept])[0]):
                        langs[p] = found
            columns = [batch.column(batch.schema.get_field_index(c)) for c in kept_columns]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(langs, pa.string())], names=[*kept_columns, name])

    schema = docs.limit(0).withColumn(name, F.lit("")).schema
    return map_batches(docs.withColumn(flag, has_letter(text)), run, schema), name


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of every document."""
    docs = table(prepare(spark), sf_dir, "documents")
    found = identify(docs, train(docs))
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
