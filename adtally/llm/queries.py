"""The operators' queries over their whole tables, and their SQL where there is one."""

from __future__ import annotations

from adtally.llm import mixing
from adtally.llm.ball_tree import op8_ball_tree_top_k
from adtally.llm.hard_negatives import op13_hard_negatives
from adtally.llm.merge_dropout import op3_merge_dropout
from adtally.llm.mixing import op1_mixing
from adtally.llm.near_dedup import op5_near_dedup
from adtally.llm.packed_ids import op10_packed_ids
from adtally.llm.packing import op11_harmonic_packing
from adtally.llm.private_data import op2_private_data
from adtally.llm.repeats import op6_repeated_passages
from adtally.llm.sketches import op9_document_fingerprints
from adtally.llm.toxicity import op4_toxicity
from adtally.llm.url_rules import op7_url_rules
from adtally.llm.whitening import op12_embedding_whitening

REGISTERED = (
    op1_mixing,
    op2_private_data,
    op3_merge_dropout,
    op4_toxicity,
    op5_near_dedup,
    op6_repeated_passages,
    op7_url_rules,
    op8_ball_tree_top_k,
    op9_document_fingerprints,
    op10_packed_ids,
    op11_harmonic_packing,
    op12_embedding_whitening,
    op13_hard_negatives,
)

QUERIES = {f.__name__: f for f in REGISTERED}

ORACLES = {"op1_mixing": mixing.ORACLE}
