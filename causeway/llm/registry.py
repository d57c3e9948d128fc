"""Queries of the operators, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from causeway.llm import archive, chat, decontaminate, fill_middle, language, lbl, near_dedup, packing, passages, secret_scan, simhash, spelling, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_lm_scoring": lbl.op1_lm_scoring,
        "op2_decontamination": decontaminate.op2_decontamination,
        "op3_packing": packing.op3_packing,
        "op4_near_dedup": near_dedup.op4_near_dedup,
        "op5_warc": archive.op5_warc,
        "op6_language_id": language.op6_language_id,
        "op7_secrets": secret_scan.op7_secrets,
        "op8_toxicity": toxicity.op8_toxicity,
        "op9_substring_dedup": passages.op9_substring_dedup,
        "op10_simhash": simhash.op10_simhash,
        "op11_fill_middle": fill_middle.op11_fill_middle,
        "op12_chat_format": chat.op12_chat_format,
        "op13_spelling": spelling.op13_spelling,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_decontamination": decontaminate.ORACLE,
        "op4_near_dedup": near_dedup.ORACLE,
        "op5_warc": archive.ORACLE,
        "op7_secrets": secret_scan.ORACLE,
        "op11_fill_middle": fill_middle.ORACLE,
        "op12_chat_format": chat.ORACLE,
        "op13_spelling": spelling.ORACLE,
    }
