"""The dealt queries and their DuckDB SQL (where SQL can express them)."""

from __future__ import annotations

from . import alignment, bpe, infill, langid, linededup, mixing, ngram_join, pq_neardup, rans, repetition, secrets, toxicity, warc

QUERIES = {
    "op1_repetition": repetition.op1_repetition,
    "op2_rans": rans.op2_rans,
    "op3_bpe": bpe.op3_bpe,
    "op4_warc": warc.op4_warc,
    "op5_mixing": mixing.op5_mixing,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_langid": langid.op7_langid,
    "op8_jaccard": ngram_join.op8_jaccard,
    "op9_pq": pq_neardup.op9_pq,
    "op10_secrets": secrets.op10_secrets,
    "op11_linededup": linededup.op11_linededup,
    "op12_alignment": alignment.op12_alignment,
    "op13_infill": infill.op13_infill,
}

ORACLE = {
    "op1_repetition": repetition.SQL,
    "op4_warc": warc.SQL,
    "op5_mixing": mixing.SQL,
    "op8_jaccard": ngram_join.SQL,
    "op9_pq": pq_neardup.SQL,
    "op11_linededup": linededup.SQL,
    "op13_infill": infill.SQL,
}
