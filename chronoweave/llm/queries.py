"""Queries and SQL of the training-data operators; their names follow the operators' numbers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from chronoweave.llm import (
    ball_tree,
    bpe,
    decontam,
    lang_id,
    line_dedup,
    lm_score,
    quality,
    simhash,
    url_filter,
    warc,
)

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_lang_id": lang_id.op1_lang_id,
        "op2_topk": ball_tree.op2_topk,
        "op3_line_dedup": line_dedup.op3_line_dedup,
        "op4_lm_score": lm_score.op4_lm_score,
        "op5_quality": quality.op5_quality,
        "op6_simhash": simhash.op6_simhash,
        "op7_bpe": bpe.op7_bpe,
        "op8_decontamination": decontam.op8_decontamination,
        "op9_warc": warc.op9_warc,
        "op10_url_filter": url_filter.op10_url_filter,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_topk": ball_tree.SQL,
        "op3_line_dedup": line_dedup.SQL,
        "op9_warc": warc.SQL,
        "op10_url_filter": url_filter.SQL,
    }
