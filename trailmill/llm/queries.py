"""Queries of the operators for training text, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import history_dedup, language, mixing, split_overlap, tokens


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": history_dedup.found,
        "p2_found": split_overlap.found,
        "p2_report": split_overlap.report,
        "p6_ids": tokens.found,
        "p6_summary": tokens.summary,
        "p7_mix": mixing.documents,
        "p7_shares": mixing.shares,
        "p8_found": language.found,
        "p8_documents": language.documents,
        "p8_segments": language.segments,
    }


def oracle_sql() -> dict[str, str]:
    """None: canonical forms, tokenizers, graphs and trained models are tested in ``tests/llm``."""
    return {}
