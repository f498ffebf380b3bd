"""The queries of this subpackage and, where SQL can express one, its SQL."""

from __future__ import annotations

from .chat import OP9_SQL, op9_chat_snapshots
from .embeddings import OP7_SQL, op7_embedding_dedup
from .jaccard import OP10_SQL, op10_ngram_jaccard
from .main_text import op11_html_extraction
from .merkle import OP12_SQL, op12_merkle_manifest
from .mixing import op1_mix_sources
from .packing import op6_pack_hilbert
from .quality import op4_quality_rules
from .sharding import op8_tiered_shards
from .token_trees import op3_token_trees
from .suffix_dedup import op5_suffix_dedup
from .toxicity import op2_toxicity
from .turn_repair import OP13_SQL, op13_turn_repair

QUERIES = {
    "op1_mix_sources": op1_mix_sources,
    "op2_toxicity": op2_toxicity,
    "op3_token_trees": op3_token_trees,
    "op4_quality_rules": op4_quality_rules,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_pack_hilbert": op6_pack_hilbert,
    "op7_embedding_dedup": op7_embedding_dedup,
    "op8_tiered_shards": op8_tiered_shards,
    "op9_chat_snapshots": op9_chat_snapshots,
    "op10_ngram_jaccard": op10_ngram_jaccard,
    "op11_html_extraction": op11_html_extraction,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_turn_repair": op13_turn_repair,
}

ORACLES: dict[str, str] = {
    "op7_embedding_dedup": OP7_SQL,
    "op9_chat_snapshots": OP9_SQL,
    "op10_ngram_jaccard": OP10_SQL,
    "op12_merkle_manifest": OP12_SQL,
    "op13_turn_repair": OP13_SQL,
}
