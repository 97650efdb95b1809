"""The registered queries of the operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from barloom.llm import bpe, chat, divergence, lineblocks, mixing, pii, quality, repair, repeats, simhash, vptree, wavelet, winnow

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat_formatting": chat.op1_chat_formatting,
    "op2_vantage_point_search": vptree.op2_vantage_point_search,
    "op3_personal_data": pii.op3_personal_data,
    "op4_quality_discriminant": quality.op4_quality_discriminant,
    "op5_simhash_near_dedup": simhash.op5_simhash_near_dedup,
    "op6_line_block_text": lineblocks.op6_line_block_text,
    "op8_bpe_round_trip": bpe.op8_bpe_round_trip,
    "op7_winnowing_decontamination": winnow.op7_winnowing_decontamination,
    "op9_repeated_bytes": repeats.op9_repeated_bytes,
    "op10_wavelet_token_files": wavelet.op10_wavelet_token_files,
    "op11_source_divergence": divergence.op11_source_divergence,
    "op12_structure_repair": repair.op12_structure_repair,
    "op13_entropy_mixing": mixing.op13_entropy_mixing,
}

ORACLE: dict[str, str] = {
    "op1_chat_formatting": chat.OP1_SQL,
    "op2_vantage_point_search": vptree.OP2_SQL,
    "op11_source_divergence": divergence.OP11_SQL,
    "op12_structure_repair": repair.OP12_SQL,
}
