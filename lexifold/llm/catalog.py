"""Queries of the training-data operators, and their SQL where it can express them."""

from __future__ import annotations

from . import alignment, branches, brown, chat, exact, language, mixing, neardup, pieces, private, rabitq, repeats, webp

QUERIES = {
    "op1_webp": webp.op1_webp,
    "op2_rabitq": rabitq.op2_rabitq,
    "op3_prefix_free": repeats.op3_prefix_free,
    "op4_language_id": language.op4_language_id,
    "op5_mixing": mixing.op5_mixing,
    "op6_pii": private.op6_pii,
    "op7_brown": brown.op7_brown,
    "op8_chat_formatting": chat.op8_chat_formatting,
    "op9_probminhash": neardup.op9_probminhash,
    "op10_sentencepiece": pieces.op10_sentencepiece,
    "op11_streaming_dedup": exact.op11_streaming_dedup,
    "op12_branch_merge": branches.op12_branch_merge,
    "op13_alignment": alignment.op13_alignment,
}
ORACLES = {"op8_chat_formatting": chat.ORACLE_SQL, "op11_streaming_dedup": exact.ORACLE_SQL}
