"""What ``__spark_entry__`` registers of this subpackage."""

from __future__ import annotations

from tidewell.llm import collocations, decontaminate, exact_dedup, language_id, license_scan, line_dedup, near_dedup, prefix_trie, quality, sentencepiece_codec, suffix_dedup, topk_search, url_filter

_MODULES = {
    "op1_quality_classifier": quality,
    "op2_sentencepiece": sentencepiece_codec,
    "op3_url_filter": url_filter,
    "op4_minhash_near_dedup": near_dedup,
    "op5_language_id": language_id,
    "op6_suffix_dedup": suffix_dedup,
    "op7_exact_dedup": exact_dedup,
    "op8_line_dedup": line_dedup,
    "op9_decontaminate": decontaminate,
    "op10_license_scan": license_scan,
    "op11_exact_top_k": topk_search,
    "op12_collocations": collocations,
    "op13_prefix_trie": prefix_trie,
}


def queries() -> dict:
    return {name: module.query for name, module in _MODULES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: module.ORACLE_SQL for name, module in _MODULES.items() if getattr(module, "ORACLE_SQL", None)}
