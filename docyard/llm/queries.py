"""Registered queries of this package and their SQL where SQL can express them."""

from __future__ import annotations

from docyard.llm import (bpe, chat, clusters, contentsort, hardneg, htmltree, license, linededup, packing, quality, simhash, topk,
                         toxicity)

QUERIES = {
    "op1_maxscore_topk": topk.op1,
    "op2_toxicity": toxicity.op2,
    "op3_packing": packing.op3,
    "op4_chat_rotation": chat.op4,
    "op5_simhash_near_dedup": simhash.op5,
    "op6_line_dedup": linededup.op6,
    "op7_license_scan": license.op7,
    "op8_quality_rules": quality.op8,
    "op9_bpe": bpe.op9,
    "op10_html_extraction": htmltree.op10,
    "op11_centroid_clustering": clusters.op11,
    "op12_exact_dedup": contentsort.op12,
    "op13_hard_negatives": hardneg.op13,
}

ORACLE: dict[str, str] = {
    "op1_maxscore_topk": topk.SQL,
    "op4_chat_rotation": chat.SQL,
    "op6_line_dedup": linededup.SQL,
    "op11_centroid_clustering": clusters.SQL,
    "op12_exact_dedup": contentsort.SQL,
    "op13_hard_negatives": hardneg.SQL,
}
