"""Queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from . import ann, chat, decontaminate, langid, linededup, mixing, neardup, suffixdedup, toxicity, urlfilter


def queries() -> dict:
    return {
        "op1_near_duplicates": neardup.op1_near_duplicates,
        "op2_mixing": mixing.op2_mixing,
        "op3_language_id": langid.op3_language_id,
        "op4_suffix_dedup": suffixdedup.op4_suffix_dedup,
        "op5_toxicity": toxicity.op5_toxicity,
        "op6_line_dedup": linededup.op6_line_dedup,
        "op7_nearest_neighbours": ann.op7_nearest_neighbours,
        "op8_url_filters": urlfilter.op8_url_filters,
        "op9_chat_formatting": chat.op9_chat_formatting,
        "op10_decontamination": decontaminate.op10_decontamination,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_near_duplicates": neardup.SQL,
        "op2_mixing": mixing.SQL,
        "op4_suffix_dedup": suffixdedup.SQL,
        "op6_line_dedup": linededup.SQL,
        "op8_url_filters": urlfilter.SQL,
        "op9_chat_formatting": chat.SQL,
        "op10_decontamination": decontaminate.SQL,
    }
