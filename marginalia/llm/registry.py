"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from marginalia.llm import ann, bpe, exact, lines, mixing, quality, simhash, toxicity, urls, wrappers

QUERIES = {
    f.__name__: f
    for f in (
        bpe.op1_byte_bpe, simhash.op2_simhash_trie, mixing.op3_curriculum_mix, lines.op4_line_dedup, exact.op5_stateful_exact,
        toxicity.op6_transducer_toxicity, quality.op7_attention_quality, urls.op8_host_rank, wrappers.op9_wrapper_text, ann.op10_multiprobe_ann,
    )
}

ORACLE_SQL = {
    "op3_curriculum_mix": mixing.ORACLE_SQL,
    "op4_line_dedup": lines.ORACLE_SQL,
    "op5_stateful_exact": exact.ORACLE_SQL,
    "op8_host_rank": urls.ORACLE_SQL,
}
