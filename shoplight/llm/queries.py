"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shoplight.llm import exact_dedup, language, neighbours, ngram_join, packing, pieces, prefix_trie, pseudonyms, quality, ranked_search, sharding, suffix_dedup, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": sharding.op1_sharding,
    "op2_ngram_join": ngram_join.op2_ngram_join,
    "op3_suffix_dedup": suffix_dedup.op3_suffix_dedup,
    "op4_language": language.op4_language,
    "op5_pii": pseudonyms.op5_pii,
    "op6_pieces": pieces.op6_pieces,
    "op7_exact_dedup": exact_dedup.op7_exact_dedup,
    "op8_quality": quality.op8_quality,
    "op9_packing": packing.op9_packing,
    "op10_neighbours": neighbours.op10_neighbours,
    "op11_ranked_search": ranked_search.op11_ranked_search,
    "op12_prefix_trie": prefix_trie.op12_prefix_trie,
    "op13_toxicity": toxicity.op13_toxicity,
}

CHECKS: dict[str, str] = {
    "op1_sharding": sharding.SQL,
    "op7_exact_dedup": exact_dedup.SQL,
    "op11_ranked_search": ranked_search.SQL,
    "op12_prefix_trie": prefix_trie.SQL,
}
