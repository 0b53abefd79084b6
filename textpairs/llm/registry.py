"""Queries of this subpackage by name, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from . import ann, langid, linededup, manifest, packing, pieces, pii, polytope, resample, rules, simhash, targeted, warc

QUERIES = {
    "op1_sampled_pieces": pieces.op1_sampled_pieces,
    "op2_language_id": langid.op2_language_id,
    "op3_personal_data": pii.op3_personal_data,
    "op4_importance_resampling": resample.op4_importance_resampling,
    "op5_quality_rules": rules.op5_quality_rules,
    "op6_simhash": simhash.op6_simhash,
    "op7_packing": packing.op7_packing,
    "op8_line_dedup": linededup.op8_line_dedup,
    "op9_hilbert_neighbours": ann.op9_hilbert_neighbours,
    "op10_warc_derivatives": warc.op10_warc_derivatives,
    "op11_polytope_duplicates": polytope.op11_polytope_duplicates,
    "op12_manifest": manifest.op12_manifest,
    "op13_target_resampling": targeted.op13_target_resampling,
}

ORACLE_SQL: dict[str, str] = {"op10_warc_derivatives": warc.ORACLE_SQL, "op12_manifest": manifest.ORACLE_SQL}
