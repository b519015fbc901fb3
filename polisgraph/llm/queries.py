"""The subpackage's queries and, where SQL can express them, the same in DuckDB SQL."""

from __future__ import annotations

from polisgraph.llm import decontaminate, jaccard, langid, license, linededup, maxscore, packing, tokenbin, tokencount, topk, toxicity, trie, warc

QUERIES = {
    "op1_decontaminate": decontaminate.op1_decontaminate,
    "op2_packing": packing.op2_packing,
    "op3_language": langid.op3_language,
    "op4_line_dedup": linededup.op4_line_dedup,
    "op5_license_scan": license.op5_license_scan,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_topk_search": topk.op7_topk_search,
    "op8_ngram_jaccard": jaccard.op8_ngram_jaccard,
    "op9_token_ids": tokenbin.op9_token_ids,
    "op10_warc": warc.op10_warc,
    "op11_token_counts": tokencount.op11_token_counts,
    "op12_lexical_search": maxscore.op12_lexical_search,
    "op13_prefix_trie": trie.op13_prefix_trie,
}

ORACLE_SQL = {
    "op1_decontaminate": decontaminate.OP1_SQL,
    "op7_topk_search": topk.OP7_SQL,
    "op8_ngram_jaccard": jaccard.OP8_SQL,
    "op10_warc": warc.OP10_SQL,
    "op12_lexical_search": maxscore.OP12_SQL,
    "op13_prefix_trie": trie.OP13_SQL,
}
