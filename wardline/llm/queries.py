"""Queries of the numbered operators, by name."""

from __future__ import annotations

from wardline.llm import centroids, curves, infill, langid, lattice, mixing, packing, pages, quality, rules, simhash, suffixes, warc

QUERIES = {
    "op1_best_fit_packing": packing.op1_best_fit_packing,
    "op2_mixing": mixing.op2_mixing,
    "op3_suffix_array_dedup": suffixes.op3_suffix_array_dedup,
    "op4_quality_classifier": quality.op4_quality_classifier,
    "op5_language_id": langid.op5_language_id,
    "op6_simhash_near_dedup": simhash.op6_simhash_near_dedup,
    "op7_embedding_near_dedup": lattice.op7_embedding_near_dedup,
    "op8_nearest_neighbours": curves.op8_nearest_neighbours,
    "op9_warc": warc.op9_warc,
    "op10_html_extraction": pages.op10_html_extraction,
    "op11_fill_in_middle": infill.op11_fill_in_middle,
    "op12_quality_rules": rules.op12_quality_rules,
    "op13_centroid_clustering": centroids.op13_centroid_clustering,
}
ORACLE_SQL: dict[str, str] = {"op2_mixing": mixing.ORACLE_OP2, "op7_embedding_near_dedup": lattice.ORACLE_OP7, "op9_warc": warc.ORACLE_OP9, "op11_fill_in_middle": infill.ORACLE_OP11, "op12_quality_rules": rules.ORACLE_OP12, "op13_centroid_clustering": centroids.ORACLE_OP13}
