"""Queries of the training-data operators and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from . import decontamination, html_extraction, jaccard_join, license_scan, packing, pii, quality_rules, sharding, url_filters, warc

QUERIES = {
    "op1_license_scan": license_scan.op1_license_scan,
    "op2_sharding": sharding.op2_sharding,
    "op3_url_filters": url_filters.op3_url_filters,
    "op4_ngram_jaccard_join": jaccard_join.op4_ngram_jaccard_join,
    "op5_warc": warc.op5_warc,
    "op6_html_extraction": html_extraction.op6_html_extraction,
    "op7_packing": packing.op7_packing,
    "op8_benchmark_decontamination": decontamination.op8_benchmark_decontamination,
    "op9_pii": pii.op9_pii,
    "op10_quality_rules": quality_rules.op10_quality_rules,
}

ORACLES = {
    "op3_url_filters": url_filters.ORACLE_SQL,
    "op4_ngram_jaccard_join": jaccard_join.ORACLE_SQL,
    "op5_warc": warc.ORACLE_SQL,
    "op10_quality_rules": quality_rules.ORACLE_SQL,
}
