"""The queries of this package, as __spark_entry__.py registers them, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import brown, chat, decontaminate, jaccard, mixing, negatives, simhash, spelling, suffix, topk, toxicity, urlfilter, warc

QUERIES = {
    "op1_url_filter": urlfilter.op1_url_filter,
    "op2_chat_format": chat.op2_chat_format,
    "op3_topk": topk.op3_topk,
    "op4_decontaminate": decontaminate.op4_decontaminate,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_simhash": simhash.op6_simhash,
    "op7_suffix_dedup": suffix.op7_suffix_dedup,
    "op8_warc": warc.op8_warc,
    "op9_mixing": mixing.op9_mixing,
    "op10_brown_lm": brown.op10_brown_lm,
    "op11_hard_negatives": negatives.op11_hard_negatives,
    "op12_jaccard_join": jaccard.op12_jaccard_join,
    "op13_spelling_variants": spelling.op13_spelling_variants,
}

ORACLES = {"op1_url_filter": urlfilter.ORACLE, "op2_chat_format": chat.ORACLE, "op3_topk": topk.ORACLE, "op4_decontaminate": decontaminate.ORACLE, "op8_warc": warc.ORACLE, "op11_hard_negatives": negatives.ORACLE, "op12_jaccard_join": jaccard.ORACLE}
