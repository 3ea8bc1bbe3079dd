"""The queries of the corpus operators, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from tessera.llm import exact_dedup, langid, lexical_search, licenses, lm, mixing, near_dedup, packing, quality, relative_lz, secrets, suffix_dedup, vector_codes

QUERIES = {
    "op1_packing": packing.query,
    "op2_secret_scans": secrets.query,
    "op3_language_id": langid.query,
    "op4_lm_scoring": lm.query,
    "op5_near_dedup": near_dedup.query,
    "op6_exact_dedup": exact_dedup.query,
    "op7_suffix_dedup": suffix_dedup.query,
    "op8_quality_rules": quality.query,
    "op9_mixing": mixing.query,
    "op10_license_scans": licenses.query,
    "op11_lexical_search": lexical_search.query,
    "op12_vector_codes": vector_codes.query,
    "op13_substring_dedup": relative_lz.query,
}
ORACLES = {
    "op6_exact_dedup": exact_dedup.ORACLE,
    "op11_lexical_search": lexical_search.ORACLE,
    "op12_vector_codes": vector_codes.ORACLE,
    "op13_substring_dedup": relative_lz.ORACLE,
}
