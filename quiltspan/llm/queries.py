"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from . import embedding, html, imatch, lexical_search, mixing, packing, pii, quality, simhash, spelling, toxicity, url_filter, warc

QUERIES = {
    "op1_embedding_near_dedup": embedding.op1_embedding_near_dedup,
    "op2_html_extraction": html.op2_html_extraction,
    "op3_url_filter": url_filter.op3_url_filter,
    "op4_warc": warc.op4_warc,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_quality_rules": quality.op6_quality_rules,
    "op7_simhash_near_dedup": simhash.op7_simhash_near_dedup,
    "op8_pii_spans": pii.op8_pii_spans,
    "op9_pack_documents": packing.op9_pack_documents,
    "op10_mix_sources": mixing.op10_mix_sources,
    "op11_imatch_fingerprints": imatch.op11_imatch_fingerprints,
    "op12_ranked_search": lexical_search.op12_ranked_search,
    "op13_spelling_variants": spelling.op13_spelling_variants,
}
ORACLES = {"op3_url_filter": url_filter.OP3_SQL, "op10_mix_sources": mixing.OP10_SQL, "op11_imatch_fingerprints": imatch.OP11_SQL, "op12_ranked_search": lexical_search.OP12_SQL}
