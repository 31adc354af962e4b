"""All registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

FAMILIES: tuple[str, ...] = ("store_plans", "retrieve_plans", "shape_plans", "ingest_plans", "question_plans", "judge_plans", "layout_plans", "ocr_plans", "stream_plans")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for name in FAMILIES:
        found |= import_module(f"corvida.plans.{name}").QUERIES
    return found


def oracle_sql() -> dict[str, str]:
    found: dict[str, str] = {}
    for name in FAMILIES:
        found |= import_module(f"corvida.plans.{name}").ORACLES
    return found
