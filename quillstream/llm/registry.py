"""Queries of the training-data operators, one per operator, and their SQL where SQL can express them."""

from __future__ import annotations

from quillstream.llm import bpe, decontaminate, license_scan, near_dedup, quality, substring_dedup, token_output, topk, url_filter, warc

QUERIES = {
    "op1_near_dedup": near_dedup.op1_near_dedup,
    "op2_substring_dedup": substring_dedup.op2_substring_dedup,
    "op3_bpe": bpe.op3_bpe,
    "op4_license_scan": license_scan.op4_license_scan,
    "op5_url_filter": url_filter.op5_url_filter,
    "op6_exact_topk": topk.op6_exact_topk,
    "op7_quality": quality.op7_quality,
    "op8_decontaminate": decontaminate.op8_decontaminate,
    "op9_token_output": token_output.op9_token_output,
    "op10_warc": warc.op10_warc,
}

ORACLE_SQL = {
    "op1_near_dedup": near_dedup.OP1_SQL,
    "op2_substring_dedup": substring_dedup.OP2_SQL,
    "op4_license_scan": license_scan.OP4_SQL,
    "op5_url_filter": url_filter.OP5_SQL,
    "op6_exact_topk": topk.OP6_SQL,
    "op10_warc": warc.OP10_SQL,
}
