"""Training-data operators. Nothing else in the package imports this subpackage."""

from quadrille.llm import decontaminate, license_scan, line_dedup, lm_scoring, mixing, quality, secret_scan, sharding, simhash, suffix_dedup

QUERIES = {
    "op4_suffix_levels": suffix_dedup.op4_suffix_levels,
    "op5_segment_edit_join": line_dedup.op5_segment_edit_join,
    "op2_cross_entropy_difference": lm_scoring.op2_cross_entropy_difference,
    "op6_license_sentences": license_scan.op6_license_sentences,
    "op3_golay_simhash": simhash.op3_golay_simhash,
    "op1_fm_index": decontaminate.op1_fm_index,
    "op7_line_frequency": quality.op7_line_frequency,
    "op8_entropy_secrets": secret_scan.op8_entropy_secrets,
    "op9_feistel_shards": sharding.op9_feistel_shards,
    "op10_low_discrepancy_mix": mixing.op10_low_discrepancy_mix,
}

ORACLES = {
    "op4_suffix_levels": suffix_dedup.OP4_SQL,
    "op6_license_sentences": license_scan.OP6_SQL,
    "op1_fm_index": decontaminate.OP1_SQL,
    "op7_line_frequency": quality.OP7_SQL,
    "op10_low_discrepancy_mix": mixing.OP10_SQL,
}
