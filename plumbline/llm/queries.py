"""The queries of the subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from plumbline.llm import alignment, exact_dedup, language, line_dedup, mixing, packing, quality, repeats, simhash, substring_dedup, tokencount, topk, urlfilter

QUERIES = {
    "op1_substring_dedup": substring_dedup.op1_substring_dedup,
    "op2_simhash": simhash.op2_simhash,
    "op3_urlfilter": urlfilter.op3_urlfilter,
    "op4_quality": quality.op4_quality,
    "op5_exact_dedup": exact_dedup.op5_exact_dedup,
    "op6_language": language.op6_language,
    "op7_packing": packing.op7_packing,
    "op8_topk": topk.op8_topk,
    "op9_tokencount": tokencount.op9_tokencount,
    "op10_mixing": mixing.op10_mixing,
    "op11_periodic_runs": repeats.op11_periodic_runs,
    "op12_line_dedup": line_dedup.op12_line_dedup,
    "op13_alignment": alignment.op13_alignment,
}
ORACLE_SQL = {
    "op3_urlfilter": urlfilter.OP3_SQL,
    "op5_exact_dedup": exact_dedup.OP5_SQL,
    "op8_topk": topk.OP8_SQL,
    "op10_mixing": mixing.OP10_SQL,
    "op12_line_dedup": line_dedup.OP12_SQL,
}
