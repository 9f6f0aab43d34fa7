"""The registered queries of the training-data operators and their SQL counterparts (None: not expressible)."""

from __future__ import annotations

import corpus_pipeline

from replyloom.llm import op1_decontaminate, op10_pii, op11_runs, op12_impact_topk, op13_merkle, op2_lines, op3_toxicity, op4_chosen_path, op5_suffix, op6_hmm, op7_chat, op8_mixing, op9_itq

Q = {
    "op1_pigeonhole_leaks": (op1_decontaminate.op1_pigeonhole_leaks, None),
    "op2_segment_lines": (op2_lines.op2_segment_lines, None),
    "op3_kneser_ney": (op3_toxicity.op3_kneser_ney, None),
    "op4_chosen_path": (op4_chosen_path.op4_chosen_path, None),
    "op5_column_bwt": (op5_suffix.op5_column_bwt, None),
    "op6_hidden_markov": (op6_hmm.op6_hidden_markov, None),
    "op7_chat_round_trip": (op7_chat.op7_chat_round_trip, op7_chat.SQL),
    "op8_fair_queue_mix": (op8_mixing.op8_fair_queue_mix, op8_mixing.SQL),
    "op9_quantised_links": (op9_itq.op9_quantised_links, None),
    "pipeline": (corpus_pipeline.run, corpus_pipeline.ORACLE_SQL),
    "op10_boosted_pii": (op10_pii.op10_boosted_pii, None),
    "op11_grammar_runs": (op11_runs.op11_grammar_runs, None),
    "op12_impact_topk": (op12_impact_topk.op12_impact_topk, op12_impact_topk.SQL),
    "op13_witness_manifest": (op13_merkle.op13_witness_manifest, op13_merkle.SQL),
}
