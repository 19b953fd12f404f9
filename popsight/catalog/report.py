"""The four stages' report documents. Each is assembled from the registered
operators, written as JSON, read back and flattened; the oracle flattens the same sections' SQL."""

from __future__ import annotations

from ..operators import report as rp
from ..sources import io
from . import oracles_so_far, queries_so_far, register

#: document -> section -> (query, key columns, numbers, texts)
DOCUMENTS = {
    "profile": {
        "dataset_info": ("a10_dataset_summary", (), ("total_records", "total_features", "total_missing_cells", "duplicate_rows"), ()),
        "target": ("a7_target_distribution", ("value",), ("count", "percentage"), ()),
        "imbalance": ("a8_imbalance_ratio", (), ("imbalance_ratio",), ()),
        "missing": ("m1_missing_profile", ("column_name",), ("position", "missing_count", "missing_percentage"),
                    ("potential_missing_indicators",)),
        "types": ("a1_infer_column_types", ("column_name",), ("position", "n_distinct", "n_rows"), ("dtype", "inferred_type")),
        "statistics": ("a2_basic_stats", ("column_name",), ("position", "min", "max", "mean", "median", "std", "q25", "q75"), ()),
        "weights": ("a9_weight_summary", (), ("min", "max", "mean", "median", "std", "zero_weights", "negative_weights"), ()),
    },
    "preprocessing": {
        "metadata": ("a13_preprocessing_metadata", (), (
            "total_records", "processed_records", "records_removed", "train_samples", "test_samples", "train_class_0",
            "train_class_1", "test_class_0", "test_class_1"), ("numeric_features", "categorical_features", "target_classes")),
        "class_balance": ("a11_class_balance", ("split", "label"), ("count", "percentage"), ()),
        "feature_groups": ("p4_feature_groups", ("feature",), ("position", "non_null", "distinct_values"), ("feature_group",)),
    },
    "classification": {
        "confusion_matrix": ("v1_confusion_matrix", (), ("tn", "fp", "fn", "tp"), ()),
        "metrics": ("v2_overall_metrics", (), ("accuracy", "f1_score", "roc_auc", "pr_auc"), ()),
        "classes": ("v3_classification_report", ("class",), ("row_order", "precision", "recall", "f1_score", "support"), ()),
        "scale": ("a12_scale_pos_weight", (), ("negatives", "positives", "scale_pos_weight"), ()),
        "best_f1": ("t2_optimal_threshold_f1", (), ("threshold", "precision", "recall", "f1", "tp", "fp", "tn", "fn"), ()),
        "best_business": ("t6_optimal_business_threshold", (), (
            "threshold", "precision", "recall", "total_targeted", "high_earners_reached", "low_earners_reached",
            "high_earners_missed", "total_revenue", "total_cost", "net_profit", "roi", "cpa_high_earner", "profit_per_target"), ()),
        "breakeven": ("t7_breakeven_threshold", (), ("breakeven_threshold",), ()),
        "strategies": ("t10_strategy_comparison", ("metric",), ("metric_order", "default_threshold", "optimal_f1", "optimal_business"), ()),
    },
    "segmentation": {
        "sizes": ("a17_segment_sizes", ("segment",), ("count", "percentage"), ()),
        "profiles": ("k8_segment_profiles", ("segment",), (
            "size", "percentage", "avg_age", "age_std", "low_income_pct", "high_income_pct", "avg_weeks_worked",
            "pct_with_capital_gains", "avg_capital_gains", "pct_with_dividends"), ()),
        "personas": ("k9_segment_personas", ("segment",), (
            "size", "avg_age", "avg_weeks_worked", "high_income_rate", "pct_with_capital_gains", "pct_with_dividends"),
            ("education", "marital_stat", "occupation_code", "sex", "age_group")),
        "rules": ("k12_segment_rules", ("segment",), ("high_income_rate",), (
            "value_tier", "marketing_strategy", "recommended_channels", "messaging_focus", "budget_allocation")),
    },
}


def _oracle(sections: dict) -> str:
    parts = []
    for name, (query, keys, numbers, texts) in sections.items():
        item = "concat_ws('/', " + ", ".join(f'CAST("{k}" AS VARCHAR)' for k in keys) + ")" if keys else "''"
        cells = [f"{{'field': '{c}', 'number': CAST(\"{c}\" AS DOUBLE), 'text': CAST(NULL AS VARCHAR)}}" for c in numbers]
        cells += [f"{{'field': '{c}', 'number': CAST(NULL AS DOUBLE), 'text': CAST(\"{c}\" AS VARCHAR)}}" for c in texts]
        parts.append(f"SELECT '{name}' AS section, item, u.field AS field, u.number AS number, u.text AS text FROM "
                     f"(SELECT {item} AS item, unnest([{', '.join(cells)}]) AS u FROM ({oracles_so_far()[query]}) AS s) AS x")
    return "\nUNION ALL\n".join(parts)


def _register(stage: str, sections: dict) -> None:
    @register(f"s7_report_{stage}", _oracle(sections))
    def report(spark, sf_dir):
        doc = rp.document(spark, {name: (queries_so_far()[query](spark, sf_dir).select(*keys, *numbers, *texts), list(keys))
                                  for name, (query, keys, numbers, texts) in sections.items()})
        path = io.scratch_path(spark, f"report-{stage}")
        io.write_report_json(doc, path)
        return rp.flatten(spark.read.schema(doc.schema).json(path), {name: list(s[1]) for name, s in sections.items()})


for _stage, _sections in DOCUMENTS.items():
    _register(_stage, _sections)
