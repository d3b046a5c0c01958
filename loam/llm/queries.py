"""The query opN_<name> of each operator, and the SQL of those that SQL can express."""

from importlib import import_module

#: Query name -> module of this subpackage.
MODULES = {
    "op1_ngram_jaccard_join": "jaccard_join",
    "op2_line_dedup": "line_dedup",
    "op3_exact_topk_search": "topk_search",
    "op4_warc_revisit": "warc",
    "op5_bpe_roundtrip": "bpe",
    "op6_token_id_output": "token_output",
    "op7_substring_dedup": "substring_dedup",
    "op8_quality_classifier": "quality",
    "op9_benchmark_decontamination": "decontaminate",
    "op10_suffix_array_dedup": "suffix_dedup",
    "op11_conversation_trie": "conversation_trie",
    "op12_centroid_clustering": "clustering",
    "op13_best_fit_packing": "packing",
}

_loaded = {name: import_module(f".{module}", __package__) for name, module in MODULES.items()}
QUERIES = {name: m.query for name, m in _loaded.items()}
ORACLE = {name: m.SQL for name, m in _loaded.items() if hasattr(m, "SQL")}
