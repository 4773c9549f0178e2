"""The corpus operators' queries and, where SQL can express one, the DuckDB SQL with the same rows."""

from __future__ import annotations

from . import bpe, decontaminate, html, kmeans, linededup, media, mixing, pii, simhash, time_parts, tokens, toxicity, urls

QUERIES = {
    "op1_media": media.op1_media,
    "op2_token_files": tokens.op2_token_files,
    "op3_url_filter": urls.op3_url_filter,
    "op4_simhash_golay": simhash.op4_simhash_golay,
    "op5_main_text": html.op5_main_text,
    "op6_decontaminate": decontaminate.op6_decontaminate,
    "op7_pii": pii.op7_pii,
    "op8_line_dedup": linededup.op8_line_dedup,
    "op9_mixing": mixing.op9_mixing,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_kmeans": kmeans.op11_kmeans,
    "op12_time_parts": time_parts.op12_time_parts,
    "op13_byte_bpe": bpe.op13_byte_bpe,
}

ORACLE_SQL = {
    "op6_decontaminate": decontaminate.OP6_SQL,
    "op8_line_dedup": linededup.OP8_SQL,
    "op9_mixing": mixing.OP9_SQL,
}
