"""The training-data queries and their SQL."""

from __future__ import annotations

from . import bpe, collocations, contamination, lengths, licenses, mixing, mixing_lm, negatives, neighbours, pii, quality, secrets, simhash

QUERIES = {
    "op1_collision_counting": neighbours.op1_collision_counting,
    "op2_simhash_near_dedup": simhash.op2_simhash_near_dedup,
    "op3_token_counts": lengths.op3_token_counts,
    "op4_mix_sources": mixing.op4_mix_sources,
    "op5_license_scans": licenses.op5_license_scans,
    "op6_byte_bpe": bpe.op6_byte_bpe,
    "op7_personal_data": pii.op7_personal_data,
    "op8_quality_rules": quality.op8_quality_rules,
    "op9_secret_scans": secrets.op9_secret_scans,
    "op10_context_mixing": mixing_lm.op10_context_mixing,
    "op11_hard_negatives": negatives.op11_hard_negatives,
    "op12_decontamination": contamination.op12_decontamination,
    "op13_collocations": collocations.op13_collocations,
}

ORACLES: dict[str, str] = {"op5_license_scans": licenses.ORACLE, "op12_decontamination": contamination.ORACLE, "op13_collocations": collocations.ORACLE}
