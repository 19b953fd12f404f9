"""Operators for training-data pipelines. Nothing else in the library imports
this package; its queries and SQL are registered when it is present."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (chat, exact, html, jaccard, lines, mixing, packing, periods, quality, sharding, spotsigs, toxicity,
               whitening)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        sharding.op1_bounded_ring_shards, quality.op2_risk_controlled_rules, lines.op3_winnowed_line_dedup,
        packing.op4_tiered_packing, spotsigs.op5_spotsigs, toxicity.op6_boosted_toxicity,
        jaccard.op7_signature_tree_join, mixing.op8_temperature_mix, chat.op9_event_sourced_chat,
        html.op10_site_template_removal, exact.op11_content_sort_dedup, whitening.op12_covariance_whitening,
        periods.op13_synchronised_runs)}


def oracle_sql() -> dict[str, str]:
    """SQL for what SQL can express; the others are tested against brute force."""
    return {"op3_winnowed_line_dedup": lines.ORACLE, "op11_content_sort_dedup": exact.ORACLE}
