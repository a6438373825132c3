"""The queries of this package, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from quernwork.llm import (
    q01_chat,
    q02_topk,
    q03_bpe,
    q04_repeats,
    q05_fingerprints,
    q06_quality,
    q07_lm,
    q08_token_counts,
    q09_simhash,
    q10_mixing,
    q11_trie,
    q12_main_text,
    q13_negatives,
)
from quernwork.sources import Tables

QUERIES: dict[str, Callable[[Tables], DataFrame]] = {
    "op1_chat_formatting": q01_chat.run,
    "op2_exact_topk": q02_topk.run,
    "op3_byte_bpe": q03_bpe.run,
    "op4_suffix_array_dedup": q04_repeats.run,
    "op5_lz_fingerprints": q05_fingerprints.run,
    "op6_quality_classifier": q06_quality.run,
    "op7_kneser_ney": q07_lm.run,
    "op8_token_counts": q08_token_counts.run,
    "op9_simhash": q09_simhash.run,
    "op10_mixing": q10_mixing.run,
    "op11_prefix_trie": q11_trie.run,
    "op12_main_text": q12_main_text.run,
    "op13_hard_negatives": q13_negatives.run,
}
ORACLES: dict[str, str] = {
    "op2_exact_topk": q02_topk.SQL,
    "op10_mixing": q10_mixing.SQL,
    "op11_prefix_trie": q11_trie.SQL,
    "op13_hard_negatives": q13_negatives.SQL,
}
