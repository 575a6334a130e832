"""The queries of the text operators by name, and SQL for those that SQL can express."""

from stockwright.llm import decontaminate, languages, pieces, quality, ropes, secrets, sharding, simhash, substrings, suffixes, tokens, trie, urls
from stockwright.llm.oracles import ORACLE_SQL

__all__ = ["ORACLE_SQL", "QUERIES"]

QUERIES = {
    "op1_simhash_dedup": simhash.op1_simhash_dedup,
    "op2_substring_dedup": substrings.op2_substring_dedup,
    "op10_suffix_array_dedup": suffixes.op10_suffix_array_dedup,
    "op3_sharding": sharding.op3_sharding,
    "op4_url_filters": urls.op4_url_filters,
    "op5_quality_rules": quality.op5_quality_rules,
    "op6_sentencepiece": pieces.op6_sentencepiece,
    "op7_token_counts": tokens.op7_token_counts,
    "op8_decontamination": decontaminate.op8_decontamination,
    "op9_secret_scans": secrets.op9_secret_scans,
    "op11_prefix_trie": trie.op11_prefix_trie,
    "op12_language_id": languages.op12_language_id,
    "op13_fill_in_middle": ropes.op13_fill_in_middle,
}
