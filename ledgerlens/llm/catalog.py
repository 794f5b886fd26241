"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import (
    language_id,
    license_scan,
    mix_sources,
    periodic_runs,
    quality_rules,
    simhash,
    suffix_merge,
    token_alignment,
    token_counts,
    token_files,
    url_filter,
    vector_links,
    word_table,
)

QUERIES = {
    "op1_language_id": language_id.op1_language_id,
    "op2_mix_sources": mix_sources.op2_mix_sources,
    "op3_suffix_merge": suffix_merge.op3_suffix_merge,
    "op4_vector_links": vector_links.op4_vector_links,
    "op5_simhash": simhash.op5_simhash,
    "op6_token_counts": token_counts.op6_token_counts,
    "op7_quality_rules": quality_rules.op7_quality_rules,
    "op8_word_table": word_table.op8_word_table,
    "op9_url_filter": url_filter.op9_url_filter,
    "op10_token_files": token_files.op10_token_files,
    "op11_license_scan": license_scan.op11_license_scan,
    "op12_periodic_runs": periodic_runs.op12_periodic_runs,
    "op13_token_alignment": token_alignment.op13_token_alignment,
}
ORACLES = {"op9_url_filter": url_filter.OP9_SQL}
