"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from . import oracles
from .lexical import op13_dual_tree_search
from .mixing import op7_entropy_mix
from .near_dedup import op6_minmax_near_dedup
from .neighbours import op1_one_bit_neighbours
from .passages import op5_with_shared_words
from .pieces import op8_transducer_pieces
from .pii import op4_checked_pii
from .quality import op3_mcd_quality
from .secrets import op10_forest_secrets
from .sharding import op2_byte_prefix_shards
from .spelling import op12_spelling_trie
from .token_files import op11_token_files
from .toxicity import op9_knn_toxicity

QUERIES = {
    "op1_one_bit_neighbours": op1_one_bit_neighbours,
    "op2_byte_prefix_shards": op2_byte_prefix_shards,
    "op3_mcd_quality": op3_mcd_quality,
    "op4_checked_pii": op4_checked_pii,
    "op5_interval_tree_dedup": op5_with_shared_words,
    "op6_minmax_near_dedup": op6_minmax_near_dedup,
    "op7_entropy_mix": op7_entropy_mix,
    "op8_transducer_pieces": op8_transducer_pieces,
    "op9_knn_toxicity": op9_knn_toxicity,
    "op10_forest_secrets": op10_forest_secrets,
    "op11_token_files": op11_token_files,
    "op12_spelling_trie": op12_spelling_trie,
    "op13_dual_tree_search": op13_dual_tree_search,
}

ORACLES: dict[str, str] = {
    "op2_byte_prefix_shards": oracles.SHARDS,
    "op6_minmax_near_dedup": oracles.NEAR_DUPLICATES,
    "op12_spelling_trie": oracles.SPELLING,
    "op13_dual_tree_search": oracles.LEXICAL,
}
