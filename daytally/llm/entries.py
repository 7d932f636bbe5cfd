"""The named queries of the text operators and the SQL that checks them."""

from __future__ import annotations

from daytally.llm import (
    bpe,
    decontaminate,
    exact_dedup,
    langid,
    licenses,
    line_dedup,
    lm,
    mixing,
    negatives,
    ngram_join,
    periodic,
    quality,
    substring_dedup,
)

QUERIES = {
    "op1_license_scan": licenses.op1_license_scan,
    "op2_quality_rules": quality.op2_quality_rules,
    "op3_suffix_dedup": substring_dedup.op3_suffix_dedup,
    "op4_line_dedup": line_dedup.op4_line_dedup,
    "op5_exact_dedup": exact_dedup.op5_exact_dedup,
    "op6_mixing": mixing.op6_mixing,
    "op7_bpe": bpe.op7_bpe,
    "op8_language_id": langid.op8_language_id,
    "op9_lm_scoring": lm.op9_lm_scoring,
    "op10_ngram_join": ngram_join.op10_ngram_join,
    "op11_periodic_runs": periodic.op11_periodic_runs,
    "op12_decontamination": decontaminate.op12_decontamination,
    "op13_hard_negatives": negatives.op13_hard_negatives,
}

SQL = {
    "op2_quality_rules": quality.ORACLE,
    "op4_line_dedup": line_dedup.ORACLE,
    "op5_exact_dedup": exact_dedup.ORACLE,
    "op6_mixing": mixing.ORACLE,
    "op10_ngram_join": ngram_join.ORACLE,
    "op11_periodic_runs": periodic.ORACLE,
    "op12_decontamination": decontaminate.ORACLE,
    "op13_hard_negatives": negatives.ORACLE,
}
