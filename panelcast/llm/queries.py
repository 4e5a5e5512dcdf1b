"""The registered corpus queries, one for each operator, and their SQL twins."""

from __future__ import annotations

from . import (chat, decontaminate, extract, fingerprint, langid, license_scan, line_dedup, minhash, packing, quality, runs,
               sql, toxicity, trie)

QUERIES = {
    "op1_html": extract.op1_html,
    "op3_packing": packing.op3_packing,
    "op2_toxicity": toxicity.op2_toxicity,
    "op4_license_scan": license_scan.op4_license_scan,
    "op5_line_dedup": line_dedup.op5_line_dedup,
    "op6_chat_format": chat.op6_chat_format,
    "op7_fingerprint": fingerprint.op7_fingerprint,
    "op8_decontaminate": decontaminate.op8_decontaminate,
    "op9_language_id": langid.op9_language_id,
    "op10_minhash": minhash.op10_minhash,
    "op11_runs": runs.op11_runs,
    "op12_trie": trie.op12_trie,
    "op13_quality": quality.op13_quality,
}

ORACLE = {
    "op4_license_scan": sql.OP4,
    "op5_line_dedup": sql.OP5,
    "op6_chat_format": sql.OP6,
    "op10_minhash": sql.OP10,
    "op11_runs": sql.OP11,
    "op12_trie": sql.OP12,
}
