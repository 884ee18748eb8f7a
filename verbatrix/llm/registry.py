"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from verbatrix.llm import ann, chat_format, exact_dedup, langid, license_scan, line_dedup, mixing, packing, simhash, url_filter


def queries() -> dict:
    return {
        "op1_line_dedup": line_dedup.op1_line_dedup,
        "op2_ann": ann.op2_ann,
        "op3_langid": langid.op3_langid,
        "op4_chat_format": chat_format.op4_chat_format,
        "op5_license_scan": license_scan.op5_license_scan,
        "op6_url_filter": url_filter.op6_url_filter,
        "op7_mixing": mixing.op7_mixing,
        "op8_exact_dedup": exact_dedup.op8_exact_dedup,
        "op9_packing": packing.op9_packing,
        "op10_simhash": simhash.op10_simhash,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_line_dedup": line_dedup.OP1_SQL,
        "op6_url_filter": url_filter.OP6_SQL,
        "op8_exact_dedup": exact_dedup.OP8_SQL,
    }
