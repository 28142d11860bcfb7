"""The queries of this subpackage and their SQL, where SQL can state them."""

from __future__ import annotations

from . import decontaminate, html, jaccard, lm, packing, pii, quality, suffixes, topk, warc

QUERIES = {
    "op1_warc": warc.op1_warc,
    "op2_lm": lm.op2_lm,
    "op3_quality": quality.op3_quality,
    "op4_packing": packing.op4_packing,
    "op5_jaccard": jaccard.op5_jaccard,
    "op6_suffixes": suffixes.op6_suffixes,
    "op7_pii": pii.op7_pii,
    "op8_decontamination": decontaminate.op8_decontamination,
    "op9_topk": topk.op9_topk,
    "op10_html": html.op10_html,
}
ORACLE_SQL = {
    "op1_warc": warc.OP1_SQL,
    "op5_jaccard": jaccard.OP5_SQL,
    "op6_suffixes": suffixes.OP6_SQL,
    "op8_decontamination": decontaminate.OP8_SQL,
    "op9_topk": topk.OP9_SQL,
}
