"""The subpackage's queries by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, byte_bpe, chat_format, exact_dedup, hpylm, langid, mixing, simhash, suffix_dedup, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": mixing.op1_mixing,
    "op2_langid": langid.op2_langid,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_hpylm": hpylm.op4_hpylm,
    "op5_exact_dedup": exact_dedup.op5_exact_dedup,
    "op6_simhash": simhash.op6_simhash,
    "op7_chat_format": chat_format.op7_chat_format,
    "op8_byte_bpe": byte_bpe.op8_byte_bpe,
    "op9_suffix_dedup": suffix_dedup.op9_suffix_dedup,
    "op10_ann": ann.op10_ann,
}

ORACLE_SQL: dict[str, str] = {"op5_exact_dedup": exact_dedup.SQL, "op7_chat_format": chat_format.SQL}
