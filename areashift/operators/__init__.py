"""DataFrame-to-DataFrame operators."""

from areashift.operators.cases import case_verdicts, connected, overlap_cases, units_of_case
from areashift.operators.checks import (
    Conserved,
    closed_case_check,
    conservation_check,
    inherited_check,
    missing_report,
    source_check,
    summarize_checks,
    target_check,
)
from areashift.operators.compare import Period, class_view, compare_periods, totals_cube
from areashift.operators.crosswalk import build_crosswalk
from areashift.operators.demographics import clean_demographics, widen_variables
from areashift.operators.frames import fingerprints, frame_differences, frame_equality
from areashift.operators.interpolate import (
    SourceSet,
    areal_interpolate,
    attach_attributes,
    interpolate_counts,
    interpolate_means,
)
from areashift.operators.joins import (
    among,
    chosen_keys,
    full_join,
    keyed_join,
    left_join,
    restrict_to,
    suffix_collisions,
)
from areashift.operators.peers import (
    assign_groups,
    first_codes,
    focus,
    partition_union,
    top_k,
)
from areashift.operators.rates import align_vintages, both_present, join_vintages
from areashift.operators.regional import (
    discrepancy,
    regional_frame,
    regional_rollup,
    sums_by,
)
from areashift.operators.reports import (
    chart_frame,
    pivot_order,
    pivoted_report,
    ranked_report,
)

__all__ = [
    "fingerprints",
    "frame_differences",
    "among",
    "case_verdicts",
    "chosen_keys",
    "connected",
    "overlap_cases",
    "units_of_case",
    "Conserved",
    "Period",
    "SourceSet",
    "align_vintages",
    "areal_interpolate",
    "assign_groups",
    "attach_attributes",
    "both_present",
    "build_crosswalk",
    "chart_frame",
    "class_view",
    "clean_demographics",
    "closed_case_check",
    "compare_periods",
    "conservation_check",
    "discrepancy",
    "first_codes",
    "focus",
    "frame_equality",
    "full_join",
    "inherited_check",
    "interpolate_counts",
    "interpolate_means",
    "join_vintages",
    "keyed_join",
    "left_join",
    "missing_report",
    "partition_union",
    "pivot_order",
    "pivoted_report",
    "ranked_report",
    "regional_frame",
    "regional_rollup",
    "restrict_to",
    "source_check",
    "suffix_collisions",
    "summarize_checks",
    "sums_by",
    "target_check",
    "top_k",
    "totals_cube",
    "widen_variables",
]
