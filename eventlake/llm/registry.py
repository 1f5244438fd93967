"""The subpackage's queries and their DuckDB SQL, by name."""

from . import decontamination, exact_dedup, jaccard_join, language_id, packing, pii, substring_dedup, suffix_dedup, toxicity, url_filter

QUERIES = {
    "op1_substring_dedup": substring_dedup.op1_substring_dedup,
    "op2_best_fit_packing": packing.op2_best_fit_packing,
    "op3_pii": pii.op3_pii,
    "op4_exact_dedup": exact_dedup.op4_exact_dedup,
    "op5_suffix_dedup": suffix_dedup.op5_suffix_dedup,
    "op6_language_id": language_id.op6_language_id,
    "op7_decontamination": decontamination.op7_decontamination,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_jaccard_join": jaccard_join.op9_jaccard_join,
    "op10_url_filter": url_filter.op10_url_filter,
}
ORACLES = {
    "op1_substring_dedup": substring_dedup.ORACLE_SQL,
    "op4_exact_dedup": exact_dedup.ORACLE_SQL,
    "op5_suffix_dedup": suffix_dedup.ORACLE_SQL,
    "op7_decontamination": decontamination.ORACLE_SQL,
    "op9_jaccard_join": jaccard_join.ORACLE_SQL,
    "op10_url_filter": url_filter.ORACLE_SQL,
}
