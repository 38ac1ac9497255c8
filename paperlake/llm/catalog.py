"""Queries of the subpackage and their SQL where SQL can express them."""

from __future__ import annotations

from .alignment import op12_tokenizer_alignment
from .compression import op6_quality_classifier, op9_language_id
from .decontamination import OP3_SQL, op3_benchmark_decontamination
from .license_scan import op7_license_scan
from .manifest import OP11_SQL, op11_merkle_manifest
from .mixing import op2_temperature_mixing
from .ngram_join import op8_ngram_jaccard_join
from .pii import op1_pii_surrogates
from .quality_rules import op5_quality_rules
from .repeats import OP10_SQL, op10_repeated_bytes
from .toxicity import op13_toxicity
from .wrapper_extraction import op4_wrapper_extraction

QUERIES = (
    op1_pii_surrogates,
    op2_temperature_mixing,
    op3_benchmark_decontamination,
    op4_wrapper_extraction,
    op5_quality_rules,
    op6_quality_classifier,
    op7_license_scan,
    op8_ngram_jaccard_join,
    op9_language_id,
    op10_repeated_bytes,
    op11_merkle_manifest,
    op12_tokenizer_alignment,
    op13_toxicity,
)


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op3_benchmark_decontamination": OP3_SQL, "op10_repeated_bytes": OP10_SQL, "op11_merkle_manifest": OP11_SQL}
