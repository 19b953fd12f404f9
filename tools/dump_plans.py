"""Write PLANS.md: the physical plans of the key operators, as Spark chose
them, with what to look for in each.

usage: python tools/dump_plans.py [sf_dir]
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from popsight.operators import encode as en  # noqa: E402
from popsight.operators import evaluate as ev  # noqa: E402
from popsight.operators import missing as mi  # noqa: E402
from popsight.operators import profile as pf  # noqa: E402
from popsight.operators import threshold as th  # noqa: E402
from popsight.session import get_spark  # noqa: E402
from popsight.sources.tables import persons  # noqa: E402

NOTES = {
    "threshold sweep (T1) from the tables": (
        "Column pruning reaches every scan (`ReadSchema`); lineitem is aggregated per order "
        "before the join; the scored rows are reduced by a partial + final HashAggregate on "
        "the grid cell (<= 82 keys) before anything else; the cell counts are broadcast to "
        "the 82-row grid; the only single-partition exchange carries those <= 82 rows."),
    "ROC AUC / average precision (V5, V6)": (
        "Rows are grouped by score with map-side combining; running totals are a window "
        "partitioned by score bucket (cut points are literals from one sketch pass), plus a "
        "broadcast of per-bucket offsets; the sums end in one partial/final aggregate."),
    "stratified split (E7 operator)": (
        "Counts per (class, md5 bucket) are aggregated; the cut table (one row per class) is "
        "broadcast; only rows of the cut bucket reach the window, which is partitioned by class "
        "over that bucket's rows."),
    "low-cardinality distributions (A6)": (
        "One Generate (unpivot) feeds one partial/final aggregate on (column, value); the "
        "chosen-column list is a broadcast semi join; top-k runs per (column, hash shard) "
        "before the per-column window."),
    "mode imputation (M9)": (
        "Modes come from one unpivot + grouped count + min(struct) per column inside a scalar "
        "subquery; filling is a projection (coalesce with map lookups), no join."),
    "duplicate removal (M5)": (
        "One hash aggregate on all columns with a partial (map-side) step, so repeated rows "
        "collapse before the shuffle."),
}


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = get_spark()
    p = persons(spark, sf_dir)
    scored = ev.scored_table(p, "label", "50000+.", "score")
    frames = {
        "threshold sweep (T1) from the tables": th.threshold_sweep(scored),
        "ROC AUC / average precision (V5, V6)": ev.rank_metrics(scored),
        "stratified split (E7 operator)": en.stratified_split(
            mi.drop_duplicates(p.drop("score")), "label", "person_id"),
        "low-cardinality distributions (A6)": pf.low_cardinality_distributions(p),
        "mode imputation (M9)": mi.impute_mode(
            mi.sentinels_to_null(p), ["class_of_worker", "migration", "birth_country"]),
        "duplicate removal (M5)": mi.drop_duplicates(p),
    }
    out = ["# Physical plans of key operators",
           "",
           f"Generated by `tools/dump_plans.py` on `{sf_dir}` (local[8], AQE on; the plans",
           "shown are the initial physical plans, before AQE's runtime re-planning; long",
           "lines are cut at 200 characters).",
           ""]
    for title, df in frames.items():
        plan = df._jdf.queryExecution().executedPlan().toString()
        lines = [ln if len(ln) <= 200 else ln[:197] + "..." for ln in plan.rstrip().splitlines()]
        out += [f"## {title}", "", NOTES[title], "", "```", *lines, "```", ""]
    with open(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))),
                           "PLANS.md"), "w") as fh:
        fh.write("\n".join(out))
    print("wrote PLANS.md")


if __name__ == "__main__":
    main()
