"""The queries of these operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import bloomlm, chatfmt, crossparse, e8dedup, editcount, mixing, ngramjoin, pagediff, piecebpe, quality

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": quality.op1_quality_rules,
    "op2_embedding_dedup": e8dedup.op2_embedding_dedup,
    "op3_lm_scores": bloomlm.op3_lm_scores,
    "op4_language_id": crossparse.op4_language_id,
    "op5_chat_format": chatfmt.op5_chat_format,
    "op6_ngram_join": ngramjoin.op6_ngram_join,
    "op7_token_counts": editcount.op7_token_counts,
    "op8_sentencepiece": piecebpe.op8_sentencepiece,
    "op9_page_text": pagediff.op9_page_text,
    "op10_source_mix": mixing.op10_source_mix,
}

ORACLES: dict[str, str] = {"op1_quality_rules": quality.oracle(), "op10_source_mix": mixing.oracle()}
