"""Queries of the corpus operators by name, and their SQL."""

from __future__ import annotations

from bucketscope.llm import benchmark, bpe, chat, fingerprint, jaccard, language, lines, secrets, sharding, toxicity

QUERIES = {
    "op1_chat": chat.op1_chat,
    "op2_fingerprints": fingerprint.op2_fingerprints,
    "op3_bpe": bpe.op3_bpe,
    "op4_lines": lines.op4_lines,
    "op5_language": language.op5_language,
    "op6_secrets": secrets.op6_secrets,
    "op7_sharding": sharding.op7_sharding,
    "op8_benchmark": benchmark.op8_benchmark,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_jaccard": jaccard.op10_jaccard,
}
ORACLES = {"op4_lines": lines.ORACLE, "op7_sharding": sharding.ORACLE, "op8_benchmark": benchmark.ORACLE}
