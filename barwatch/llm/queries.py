"""The named queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from barwatch.llm import (
    classifier, containment, fmindex, importance, infill, licences, lines, mixing, randomness, runindex, shards, simhash, urls,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_run_index": runindex.op1_run_index,
    "op2_quality": classifier.op2_quality,
    "op3_byte_shards": shards.op3_byte_shards,
    "op4_line_frequency": lines.op4_line_frequency,
    "op5_fm_index": fmindex.op5_fm_index,
    "op6_simhash": simhash.op6_simhash,
    "op7_decontamination": containment.op7_decontamination,
    "op8_licences": licences.op8_licences,
    "op9_mixing": mixing.op9_mixing,
    "op10_secrets": randomness.op10_secrets,
    "op11_url_rules": urls.op11_url_rules,
    "op12_fill_in_middle": infill.op12_fill_in_middle,
    "op13_importance_resampling": importance.op13_importance_resampling,
}

SQL: dict[str, str] = {
    "op4_line_frequency": lines.OP4_SQL,
    "op5_fm_index": fmindex.OP5_SQL,
    "op7_decontamination": containment.OP7_SQL,
    "op9_mixing": mixing.OP9_SQL,
    "op11_url_rules": urls.OP11_SQL,
    "op12_fill_in_middle": infill.OP12_SQL,
}
