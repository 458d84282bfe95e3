"""The queries of the corpus operators and their SQL, by name."""

from __future__ import annotations

from . import chat, ctph, hardneg, hmm, licenses, mixing, near, pii, repeats, sentencepiece_viterbi, spelling, topk, toxicity


def queries() -> dict:
    return {
        "op1_license_scan": licenses.query,
        "op2_topk": topk.query,
        "op3_fingerprints": ctph.query,
        "op4_pii": pii.query,
        "op5_toxicity": toxicity.query,
        "op6_sentencepiece": sentencepiece_viterbi.query,
        "op7_chat": chat.query,
        "op8_near_dedup": near.query,
        "op9_mixing": mixing.query,
        "op10_repeats": repeats.query,
        "op11_hard_negatives": hardneg.query,
        "op12_lm_scoring": hmm.query,
        "op13_spelling_variants": spelling.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_license_scan": licenses.SQL,
        "op2_topk": topk.SQL,
        "op7_chat": chat.SQL,
        "op8_near_dedup": near.SQL,
        "op9_mixing": mixing.SQL,
        "op10_repeats": repeats.SQL,
        "op11_hard_negatives": hardneg.SQL,
    }
