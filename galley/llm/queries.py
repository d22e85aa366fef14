"""The queries of the corpus operators, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from galley.llm import chat, decontamination, delta_lloyd, exact_dedup, fim, kneser_ney, licenses, line_dedup, packing, secrets, simhash, suffix_dedup, url_filter

QUERIES = {
    "op1_license_scan": licenses.op1_license_scan,
    "op2_best_fit_packing": packing.op2_best_fit_packing,
    "op3_line_dedup": line_dedup.op3_line_dedup,
    "op4_chat_format": chat.op4_chat_format,
    "op5_secret_scan": secrets.op5_secret_scan,
    "op6_exact_dedup": exact_dedup.op6_exact_dedup,
    "op7_quality_kneser_ney": kneser_ney.op7_quality_kneser_ney,
    "op8_url_filter": url_filter.op8_url_filter,
    "op9_benchmark_lsa": decontamination.op9_benchmark_lsa,
    "op10_simhash_golay": simhash.op10_simhash_golay,
    "op11_vector_codes": delta_lloyd.op11_vector_codes,
    "op12_suffix_dedup": suffix_dedup.op12_suffix_dedup,
    "op13_fill_in_middle": fim.op13_fill_in_middle,
}

ORACLE_SQL = {
    "op3_line_dedup": line_dedup.OP3_SQL,
    "op4_chat_format": chat.OP4_SQL,
    "op6_exact_dedup": exact_dedup.OP6_SQL,
    "op11_vector_codes": delta_lloyd.OP11_SQL,
    "op12_suffix_dedup": suffix_dedup.OP12_SQL,
    "op13_fill_in_middle": fim.OP13_SQL,
}
