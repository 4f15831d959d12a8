"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from importlib import import_module

#: query -> module of this subpackage that has a function of that name.
MODULES = {
    "op1_mixing": "mixing",
    "op2_tiff": "tiff",
    "op3_license_scans": "license_scan",
    "op4_ngram_jaccard": "ngram_join",
    "op5_warc": "warc",
    "op6_quality_classifier": "cotraining",
    "op7_url_filters": "urlfilter",
    "op8_toxicity": "toxicity",
    "op9_packing": "packing",
    "op10_quality_rules": "quality_rules",
}


def queries() -> dict:
    return {name: getattr(import_module(f"lodeseek.llm.{module}"), name) for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {}
    for name, module in MODULES.items():
        sql = getattr(import_module(f"lodeseek.llm.{module}"), "SQL", None)
        if sql:
            found[name] = sql
    return found
