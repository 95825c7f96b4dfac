"""The queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from lodeline.llm import embedding_dedup, exact_dedup, lm_scoring, minhash, packing, pieces, repeats, rollups, toxicity, warc

QUERIES = {
    "op1_packing": packing.op1_packing,
    "op2_token_counts": rollups.op2_token_counts,
    "op3_warc": warc.op3_warc,
    "op4_lm_scoring": lm_scoring.op4_lm_scoring,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_repeats": repeats.op6_repeats,
    "op7_minhash": minhash.op7_minhash,
    "op8_pieces": pieces.op8_pieces,
    "op9_exact_dedup": exact_dedup.op9_exact_dedup,
    "op10_caps": embedding_dedup.op10_caps,
    "token_rollup_words": rollups.token_rollup_words,
}
ORACLE_SQL = {
    "op3_warc": warc.ORACLE,
    "op7_minhash": minhash.ORACLE,
    "op9_exact_dedup": exact_dedup.ORACLE,
    "op10_caps": embedding_dedup.ORACLE,
    "token_rollup_words": rollups.ORACLE,
}
