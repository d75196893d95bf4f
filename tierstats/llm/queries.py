"""The queries of this subpackage and their SQL, where SQL can express them."""

from . import chat, decontam, license, lines, mixing, negatives, periods, pii, rules, shards, simhash, substrings, toxicity

QUERIES = {
    "op1_mix_sources": mixing.op1,
    "op2_personal_data": pii.op2,
    "op3_chat_format": chat.op3,
    "op4_substring_dedup": substrings.op4,
    "op5_benchmark_leaks": decontam.op5,
    "op6_line_dedup": lines.op6,
    "op7_quality_rules": rules.op7,
    "op8_license_scan": license.op8,
    "op9_toxicity": toxicity.op9,
    "op10_simhash": simhash.op10,
    "op11_hard_negatives": negatives.op11,
    "op12_shard_mixture": shards.op12,
    "op13_periodic_runs": periods.op13,
}

ORACLES = {
    "op1_mix_sources": mixing.ORACLE,
    "op3_chat_format": chat.ORACLE,
    "op4_substring_dedup": substrings.ORACLE,
    "op6_line_dedup": lines.ORACLE,
    "op7_quality_rules": rules.ORACLE,
    "op8_license_scan": license.ORACLE,
    "op11_hard_negatives": negatives.ORACLE,
    "op12_shard_mixture": shards.ORACLE,
    "op13_periodic_runs": periods.ORACLE,
}
