"""Queries of the training-data operators and, where SQL can express them, their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import op2_chat, op3_multiindex, op5_mixing, op6_maintext, op7_rabit, op8_simhash, op9_kdshard, op11_vafile, op12_recompress, op13_hamerly
from tessera.llm.op1_quality import op1_kneser_ney_quality
from tessera.llm.op4_bpe import op4_byte_level_bpe
from tessera.llm.op10_langid import op10_language_id


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_kneser_ney_quality": op1_kneser_ney_quality,
        "op2_chat_prefix_targets": op2_chat.op2_chat_prefix_targets,
        "op3_inverted_multi_index": op3_multiindex.op3_inverted_multi_index,
        "op4_byte_level_bpe": op4_byte_level_bpe,
        "op5_poisson_mix": op5_mixing.op5_poisson_mix,
        "op6_recurrent_blocks": op6_maintext.op6_recurrent_blocks,
        "op7_rotated_codes": op7_rabit.op7_rotated_codes,
        "op8_simhash_pivots": op8_simhash.op8_simhash_pivots,
        "op9_kd_tree_shards": op9_kdshard.op9_kd_tree_shards,
        "op10_language_id": op10_language_id,
        "op11_hard_negatives": op11_vafile.op11_hard_negatives,
        "op12_recompressed_repeats": op12_recompress.op12_recompressed_repeats,
        "op13_hamerly_codes": op13_hamerly.op13_hamerly_codes,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_chat_prefix_targets": op2_chat.ORACLE, "op5_poisson_mix": op5_mixing.ORACLE, "op11_hard_negatives": op11_vafile.ORACLE, "op12_recompressed_repeats": op12_recompress.ORACLE, "op13_hamerly_codes": op13_hamerly.ORACLE}
