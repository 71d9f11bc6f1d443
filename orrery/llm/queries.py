"""Queries over the corpus tables, one for each operator, and the SQL for those that SQL can express."""

from __future__ import annotations

from orrery.llm import byte_bpe, decontaminate, exact_dedup, langid, pii, quality, sharding, simhash, token_files, url_filter

QUERIES = {
    "op1_url_filter": url_filter.query,
    "op2_exact_dedup": exact_dedup.query,
    "op3_pii": pii.query,
    "op4_byte_bpe": byte_bpe.query,
    "op5_sharding": sharding.query,
    "op6_decontaminate": decontaminate.query,
    "op7_quality": quality.query,
    "op8_langid": langid.query,
    "op9_token_files": token_files.query,
    "op10_simhash": simhash.query,
}

ORACLES = {
    "op1_url_filter": url_filter.ORACLE,
    "op2_exact_dedup": exact_dedup.ORACLE,
}
