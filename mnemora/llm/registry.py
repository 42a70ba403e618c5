"""Queries of this package and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import bpe, exact, fingerprint, minhash, mixing, projections, quality, rewrite, search, suffix, toxicity, url_filter

QUERIES = {
    "op1_winnowing": fingerprint.op1_winnowing,
    "op2_mixing": mixing.op2_mixing,
    "op3_quality": quality.op3_quality,
    "op4_minhash": minhash.op4_minhash,
    "op5_projections": projections.op5_projections,
    "op6_byte_bpe": bpe.op6_byte_bpe,
    "op7_token_counts": bpe.op7_token_counts,
    "op8_suffix_arrays": suffix.op8_suffix_arrays,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_url_filter": url_filter.op10_url_filter,
    "op11_exact_tries": exact.op11_exact_tries,
    "op12_wand": search.op12_wand,
    "op13_schema_rewrite": rewrite.op13_schema_rewrite,
}
ORACLES = {"op5_projections": projections.ORACLE, "op10_url_filter": url_filter.ORACLE, "op11_exact_tries": exact.ORACLE, "op12_wand": search.ORACLE}
