"""Every operator on its whole table, and the SQL that states its result."""

from __future__ import annotations

from strophe.llm import (
    alignment,
    audit_repair,
    exact_dedup,
    huffman,
    jaccard,
    license_scan,
    line_dedup,
    mixing,
    packing,
    quality,
    token_counts,
    topk,
    url_filter,
)

QUERIES = {
    f.__name__: f
    for f in (
        packing.op1_packing,
        mixing.op2_mixing,
        quality.op3_quality,
        huffman.op4_huffman,
        url_filter.op5_url_filter,
        exact_dedup.op6_exact_dedup,
        jaccard.op7_jaccard,
        topk.op8_topk,
        token_counts.op9_token_counts,
        line_dedup.op10_line_dedup,
        license_scan.op11_license_scan,
        audit_repair.op12_audit_repair,
        alignment.op13_alignment,
    )
}

ORACLES = {
    "op6_exact_dedup": exact_dedup.ORACLE,
    "op7_jaccard": jaccard.ORACLE,
    "op8_topk": topk.ORACLE,
    "op10_line_dedup": line_dedup.ORACLE,
    "op11_license_scan": license_scan.ORACLE,
}
