"""The operators' queries and, where SQL can say them, the SQL with the same rows."""

from millrace.llm import chunk_fingerprints, line_frequency, mixing, near_duplicates, packing, range_coder, sharding, token_counts, toxicity, url_filter

QUERIES = {
    "op1_mixing": mixing.query,
    "op2_sharding": sharding.query,
    "op3_url_filter": url_filter.query,
    "op4_toxicity": toxicity.query,
    "op5_line_frequency": line_frequency.query,
    "op6_packing": packing.query,
    "op7_token_counts": token_counts.query,
    "op8_near_duplicates": near_duplicates.query,
    "op9_chunk_fingerprints": chunk_fingerprints.query,
    "op10_range_coder": range_coder.query,
}
ORACLES = {
    "op2_sharding": sharding.ORACLE,
    "op3_url_filter": url_filter.ORACLE,
    "op5_line_frequency": line_frequency.ORACLE,
}
