"""The queries of this subpackage and their SQL."""

from . import exact_dedup, line_dedup, mixing, near_dedup, packing, quality_classifier, quality_rules, substring_dedup, toxicity, url_filter

QUERIES = {
    "op1_substring_dedup": substring_dedup.query,
    "op2_mixing": mixing.query,
    "op3_exact_dedup": exact_dedup.query,
    "op4_toxicity": toxicity.query,
    "op5_url_filter": url_filter.query,
    "op6_near_dedup": near_dedup.query,
    "op7_quality_rules": quality_rules.query,
    "op8_packing": packing.query,
    "op9_quality_classifier": quality_classifier.query,
    "op10_line_dedup": line_dedup.query,
}

SQL = {
    "op1_substring_dedup": substring_dedup.SQL,
    "op2_mixing": mixing.SQL,
    "op3_exact_dedup": exact_dedup.SQL,
    "op5_url_filter": url_filter.SQL,
    "op6_near_dedup": near_dedup.SQL,
    "op10_line_dedup": line_dedup.SQL,
}
