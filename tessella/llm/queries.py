"""Registered queries of this subpackage and the SQL that each must agree with."""

from __future__ import annotations

from . import chat, decontaminate, license_scan, minhash_dedup, pack, quality, simhash, substring_dedup, token_count, url_filter

QUERIES = {
    "op1_minhash_dedup": minhash_dedup.op1,
    "op2_pack": pack.op2,
    "op3_token_counts": token_count.op3,
    "op4_decontaminate": decontaminate.op4,
    "op5_simhash": simhash.op5,
    "op6_chat_rotation": chat.op6,
    "op7_url_graph": url_filter.op7,
    "op8_substring_dedup": substring_dedup.op8,
    "op9_license_scan": license_scan.op9,
    "op10_quality": quality.op10,
}

SQL = {
    "op1_minhash_dedup": minhash_dedup.OP1_SQL,
    "op4_decontaminate": decontaminate.OP4_SQL,
    "op6_chat_rotation": chat.OP6_SQL,
    "op7_url_graph": url_filter.OP7_SQL,
    "op8_substring_dedup": substring_dedup.OP8_SQL,
    "op9_license_scan": license_scan.OP9_SQL,
}
