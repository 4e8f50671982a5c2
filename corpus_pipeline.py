"""From raw documents to packed training sequences.

Each stage takes the documents that the stage before it kept and gives those that it keeps, with the
same columns; the last gives the places of all pieces in the packed sequences. Between stages the documents
are a Parquet table in the shared folder, so a lost executor costs part of one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoplight.llm import exact_dedup, language, ngram_join, packing, pseudonyms
from shoplight.llm.common import table
from shoplight.session import prepare, stored


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language identification: documents in no language go, those whose text is null or has no letter.

    The classifiers are fitted on the documents' own known languages. When there are none, nothing can be
    told about any text, and only texts without letters go.
    """
    machines = language.train(docs)
    if machines is None:
        return docs.filter(language.has_letter("text"))
    found, name = language.with_language(docs, machines)
    return found.filter(F.col(name) != language.UNDETERMINED).drop(name)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exact deduplication: one document of each group of equal texts stays."""
    return exact_dedup.without_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: of each group of linked documents the one with the smallest id stays."""
    return ngram_join.without_near_copies(docs)


def replace_personal_values(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal values become pseudonyms; no document goes. Other columns, such as the raw length, stay as they are."""
    return pseudonyms.pseudonymise(docs, pseudonyms.session_key(spark))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its sequence and its place there."""
    return packing.pack(docs, packing.vocabulary_path())


STAGES = [
    ("language", keep_languages),
    ("exact_dedup", drop_exact_copies),
    ("near_duplicates", drop_near_copies),
    ("pii", replace_personal_values),
    ("packing", pack_sequences),
]

# Trained classifiers, tokens and a packing search are beyond SQL; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written and read again."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
