"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from graphloom.llm import bitpack, decontamination, licenses, packing, pii, pipeline, quality, sharding, simhash, toxicity, url_filter

QUERIES = {
    "op1_best_fit_packing": packing.query,
    "op2_pii_sanitise": pii.query,
    "op3_quality_rules": quality.query,
    "op4_kd_sharding": sharding.query,
    "op5_license_scan": licenses.query,
    "op6_decontamination": decontamination.query,
    "op7_bit_packing": bitpack.query,
    "op8_toxicity": toxicity.query,
    "op9_url_filter": url_filter.query,
    "op10_simhash": simhash.query,
    "pipeline": pipeline.run,
}

#: DuckDB SQL; the other queries are held against brute-force versions in tests/llm.
ORACLES = {"op9_url_filter": url_filter.oracle()}
