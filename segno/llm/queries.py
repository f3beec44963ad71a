"""Queries of this subpackage over the whole tables, and DuckDB SQL where it can express them."""

from __future__ import annotations

from . import decontaminate, exact_dedup, html_extract, langid, license_scan, line_dedup, packing, periodic_runs, sharding, simhash, toxicity, vector_codes, warc
from .common import table

QUERIES = {
    "op10_html_extraction": lambda spark, d: html_extract.extract_digest(table(spark, d, "pages")),
    "op11_periodic_runs": lambda spark, d: periodic_runs.runs_digest(table(spark, d, "documents")),
    "op12_vector_codes": lambda spark, d: vector_codes.codes_digest(table(spark, d, "embeddings")),
    "op13_warc": lambda spark, d: warc.archive_digest(table(spark, d, "pages")),
    "op1_license_scan": lambda spark, d: license_scan.license_digest(table(spark, d, "documents")),
    "op2_sharding": lambda spark, d: sharding.sharding_digest(table(spark, d, "documents")),
    "op3_line_dedup": lambda spark, d: line_dedup.dedup_lines(table(spark, d, "documents")),
    "op4_simhash": lambda spark, d: simhash.simhash_digest(table(spark, d, "documents")),
    "op5_packing": lambda spark, d: packing.pack(table(spark, d, "documents")),
    "op6_decontamination": lambda spark, d: decontaminate.contamination_digest(table(spark, d, "documents"), table(spark, d, "benchmark")),
    "op7_language_id": lambda spark, d: langid.language_digest(table(spark, d, "documents")),
    "op8_exact_dedup": lambda spark, d: exact_dedup.exact_dedup(table(spark, d, "documents")),
    "op9_toxicity": lambda spark, d: toxicity.toxicity_digest(table(spark, d, "documents"), table(spark, d, "labels")),
}

ORACLES = {
    "op11_periodic_runs": periodic_runs.SQL,
    "op12_vector_codes": vector_codes.SQL,
    "op13_warc": warc.SQL,
    "op1_license_scan": license_scan.SQL,
    "op6_decontamination": decontaminate.SQL,
    "op8_exact_dedup": exact_dedup.SQL,
}
