"""The queries of this subpackage."""

from millrace.llm import alignment, chatformat, decontaminate, htmlmain, langid, linededup, mixing, ngramjoin, packing, quality, tokencounts, toxicity, whitening
from millrace.llm.oracles import ORACLES

QUERIES = {
    "op1_chat_formatting": chatformat.op1,
    "op2_quality_rules": quality.op2,
    "op3_source_mixing": mixing.op3,
    "op4_benchmark_decontamination": decontaminate.op4,
    "op5_token_counts": tokencounts.op5,
    "op6_html_extraction": htmlmain.op6,
    "op7_line_dedup": linededup.op7,
    "op8_toxicity": toxicity.op8,
    "op9_ngram_jaccard_join": ngramjoin.op9,
    "op10_language_id": langid.op10,
    "op11_packing": packing.op11,
    "op12_tokenizer_alignment": alignment.op12,
    "op13_embedding_whitening": whitening.op13,
}

__all__ = ["ORACLES", "QUERIES"]
