"""The registered queries of the llm operators and their SQL."""

from __future__ import annotations

from . import bpe, conversationtrie, decontaminate, discriminant, html, linededup, lm, ngramjoin, quality, tokencount, toxicity, urlfilter, vectorcode


def queries() -> dict:
    return {
        "op1_benchmark_decontamination": decontaminate.op1_benchmark_decontamination,
        "op2_quality_rules": quality.op2_quality_rules,
        "op3_line_dedup": linededup.op3_line_dedup,
        "op4_lm_scoring": lm.op4_lm_scoring,
        "op5_bpe_encode_decode": bpe.op5_bpe_encode_decode,
        "op6_token_counts": tokencount.op6_token_counts,
        "op7_toxicity": toxicity.op7_toxicity,
        "op8_html_extraction": html.op8_html_extraction,
        "op9_url_filters": urlfilter.op9_url_filters,
        "op10_ngram_jaccard_join": ngramjoin.op10_ngram_jaccard_join,
        "op11_vector_codes": vectorcode.op11_vector_codes,
        "op12_quality_classifier": discriminant.op12_quality_classifier,
        "op13_conversation_trie": conversationtrie.op13_conversation_trie,
    }


def oracle_sql() -> dict[str, str]:
    """Op 4 to 8 and 12 learn, follow a tokenizer file or parse markup, which SQL does not express; tests hold them against brute force."""
    return {
        "op1_benchmark_decontamination": decontaminate.OP1_SQL,
        "op2_quality_rules": quality.OP2_SQL,
        "op3_line_dedup": linededup.OP3_SQL,
        "op9_url_filters": urlfilter.OP9_SQL,
        "op10_ngram_jaccard_join": ngramjoin.OP10_SQL,
        "op11_vector_codes": vectorcode.OP11_SQL,
        "op13_conversation_trie": conversationtrie.OP13_SQL,
    }
