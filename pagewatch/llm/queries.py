"""The registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

from pagewatch.llm import alignment, bpe, exact, filter_audit, id_files, language, mixing, packing, quality, secret_scan, simhash, warc, wrappers

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_language_id": language.op2_language_id,
    "op3_warc": warc.op3_warc,
    "op4_bpe_round_trip": bpe.op4_bpe_round_trip,
    "op5_html_text": wrappers.op5_html_text,
    "op6_exact_dedup": exact.op6_exact_dedup,
    "op7_simhash_dedup": simhash.op7_simhash_dedup,
    "op8_secret_scan": secret_scan.op8_secret_scan,
    "op9_token_id_files": id_files.op9_token_id_files,
    "op10_quality_rules": quality.op10_quality_rules,
    "op11_tokenizer_alignment": alignment.op11_tokenizer_alignment,
    "op12_best_fit_packing": packing.op12_best_fit_packing,
    "op13_filter_audit": filter_audit.op13_filter_audit,
}

SQL = {
    "op1_mixing": mixing.SQL,
    "op3_warc": warc.SQL,
    "op6_exact_dedup": exact.SQL,
    "op13_filter_audit": filter_audit.SQL,
}
