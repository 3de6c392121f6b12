"""The registered queries of this subpackage and their SQL, by name."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

NAMES = (
    "op1_quality_rules",
    "op2_quality_classifier",
    "op3_byte_bpe",
    "op4_warc",
    "op5_line_dedup",
    "op6_decontaminate",
    "op7_suffix_dedup",
    "op8_pii",
    "op9_ngram_jaccard",
    "op10_language_id",
    "op11_sharding",
    "op12_hard_negatives",
    "op13_centroids",
)


def _module(name: str):
    return importlib.import_module(f"docaudit.llm.{name}")


def load() -> None:
    """Imports every operator, so that a library that one of them lacks is known at once."""
    for name in NAMES:
        _module(name)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: getattr(_module(name), name) for name in NAMES}


def oracle_sql() -> dict[str, str]:
    return {name: _module(name).SQL for name in NAMES if getattr(_module(name), "SQL", None)}
