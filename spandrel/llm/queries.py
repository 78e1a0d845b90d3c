"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from spandrel.llm import bpe, counts, langid, line_dedup, mixing, neardup_vectors, ngram_join, sharding, token_files, topk

QUERIES = {
    "op1_langid": langid.query,
    "op2_neardup_vectors": neardup_vectors.query,
    "op3_bpe": bpe.query,
    "op4_sharding": sharding.query,
    "op5_line_dedup": line_dedup.query,
    "op6_topk": topk.query,
    "op7_mixing": mixing.query,
    "op8_token_files": token_files.query,
    "op9_ngram_join": ngram_join.query,
    "op10_edit_counts": counts.query,
}
ORACLES = {
    "op9_ngram_join": ngram_join.ORACLE,
    "op2_neardup_vectors": neardup_vectors.ORACLE,
    "op6_topk": topk.ORACLE,
    "op7_mixing": mixing.ORACLE,
}
