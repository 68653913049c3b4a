"""The queries of this subpackage and, where SQL can express them, the same in DuckDB's SQL."""

from __future__ import annotations

from veridoc.llm import additive, bpe, collocations, decontaminate, divergence, langid, licences, lines, mixing, quality, simhash, tokens, warczip

QUERIES = {
    "op1_decontaminate": decontaminate.op1_decontaminate,
    "op2_line_dedup": lines.op2_line_dedup,
    "op3_simhash": simhash.op3_simhash,
    "op4_token_planes": tokens.op4_token_planes,
    "op5_warc_zip": warczip.op5_warc_zip,
    "op6_additive_ann": additive.op6_additive_ann,
    "op7_quality_cnn": quality.op7_quality_cnn,
    "op8_source_mix": mixing.op8_source_mix,
    "op9_licence_rules": licences.op9_licence_rules,
    "op10_kernel_langid": langid.op10_kernel_langid,
    "op11_duckdb_bpe": bpe.op11_duckdb_bpe,
    "op12_source_divergence": divergence.op12_source_divergence,
    "op13_son_collocations": collocations.op13_son_collocations,
}

SQL = {
    "op2_line_dedup": lines.OP2_SQL,
    "op5_warc_zip": warczip.OP5_SQL,
    "op8_source_mix": mixing.OP8_SQL,
    "op9_licence_rules": licences.OP9_SQL,
    "op12_source_divergence": divergence.OP12_SQL,
    "op13_son_collocations": collocations.OP13_SQL,
}
