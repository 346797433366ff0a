"""The queries of this subpackage, one for each operator, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strandloom.llm.bpe import op4_streaming_bpe
from strandloom.llm.clustering import OP13_SQL, op13_yinyang
from strandloom.llm.gam import op11_additive_model
from strandloom.llm.language import op3_subword_softmax
from strandloom.llm.mixing import op9_entropy_balance
from strandloom.llm.negatives import OP12_SQL, op12_norm_buckets
from strandloom.llm.neardup import OP1_SQL, op1_chosen_path
from strandloom.llm.quality import op10_kneser_ney
from strandloom.llm.secrets import OP6_SQL, op6_linked_credentials
from strandloom.llm.sharding import op5_hash_tree
from strandloom.llm.simhash import op2_simhash
from strandloom.llm.substrings import OP8_SQL, op8_suffix_trees
from strandloom.llm.urls import OP7_FAMILIES_SQL, OP7_SQL, op7_blocked_families, op7_bloom_cascade

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chosen_path": op1_chosen_path,
    "op2_simhash": op2_simhash,
    "op3_subword_softmax": op3_subword_softmax,
    "op4_streaming_bpe": op4_streaming_bpe,
    "op5_hash_tree": op5_hash_tree,
    "op6_linked_credentials": op6_linked_credentials,
    "op7_bloom_cascade": op7_bloom_cascade,
    "op7_blocked_families": op7_blocked_families,
    "op8_suffix_trees": op8_suffix_trees,
    "op9_entropy_balance": op9_entropy_balance,
    "op10_kneser_ney": op10_kneser_ney,
    "op11_additive_model": op11_additive_model,
    "op12_norm_buckets": op12_norm_buckets,
    "op13_yinyang": op13_yinyang,
}
ORACLES: dict[str, str] = {
    "op1_chosen_path": OP1_SQL,
    "op6_linked_credentials": OP6_SQL,
    "op7_bloom_cascade": OP7_SQL,
    "op7_blocked_families": OP7_FAMILIES_SQL,
    "op8_suffix_trees": OP8_SQL,
    "op12_norm_buckets": OP12_SQL,
    "op13_yinyang": OP13_SQL,
}
