"""The queries of this package, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from tessera.llm import alignment, fingerprints, language_id, language_model, line_dedup, merkle, minhash, mixing, packing, quality_rules, resampling, secrets, warc

QUERIES = {
    "op1_quality_rules": quality_rules.query,
    "op2_language_model": language_model.query,
    "op3_fingerprints": fingerprints.query,
    "op4_warc": warc.query,
    "op5_mixing": mixing.query,
    "op6_language_id": language_id.query,
    "op7_packing": packing.query,
    "op8_minhash": minhash.query,
    "op9_line_dedup": line_dedup.query,
    "op10_resampling": resampling.query,
    "op11_merkle": merkle.query,
    "op12_secrets": secrets.query,
    "op13_alignment": alignment.query,
}

ORACLE_SQL = {
    "op4_warc": warc.ORACLE,
    "op5_mixing": mixing.ORACLE,
    "op8_minhash": minhash.ORACLE,
    "op11_merkle": merkle.ORACLE,
}
