"""The registered queries of this subpackage, and the SQL of those that SQL can express."""

from . import codebooks, exact_dedup, html_extract, language_id, minhash, mixing, packing, secret_scan, simhash, token_counts, topk, toxicity, whitening

QUERIES = {
    "op1_mix_sources": mixing.query,
    "op2_token_counts": token_counts.query,
    "op3_html_extract": html_extract.query,
    "op4_best_fit_pack": packing.query,
    "op5_exact_dedup": exact_dedup.query,
    "op6_toxicity": toxicity.query,
    "op7_language_id": language_id.query,
    "op8_secret_scan": secret_scan.query,
    "op9_exact_topk": topk.query,
    "op10_simhash_dedup": simhash.query,
    "op11_minhash_dedup": minhash.query,
    "op12_code_vectors": codebooks.query,
    "op13_whiten": whitening.query,
}
ORACLE_SQL = {
    "op5_exact_dedup": exact_dedup.ORACLE_SQL,
    "op8_secret_scan": secret_scan.ORACLE_SQL,
    "op9_exact_topk": topk.ORACLE_SQL,
    "op11_minhash_dedup": minhash.ORACLE_SQL,
    "op12_code_vectors": codebooks.ORACLE_SQL,
}
