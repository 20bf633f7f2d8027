"""The queries of this subpackage."""

from __future__ import annotations

from .ball_tree import op9_ball_tree_top_k
from .centroid_clusters import op12_centroid_clusters
from .collocations import op11_collocations
from .hilbert_packing import op10_hilbert_packing
from .html_extract import op1_consensus_html
from .huffman_ids import op2_huffman_ids
from .language_id import op4_language_id
from .line_dedup import op8_line_set_join
from .minmax_dedup import op5_minmax_near_dedup
from .oracle import ORACLE
from .suffix_dedup import op6_suffix_dedup
from .token_trees import op3_token_trees
from .url_rules import op13_url_rules
from .wu_manber import op7_wu_manber_decontaminate

QUERIES = {
    "op1_consensus_html": op1_consensus_html,
    "op2_huffman_ids": op2_huffman_ids,
    "op3_token_trees": op3_token_trees,
    "op4_language_id": op4_language_id,
    "op5_minmax_near_dedup": op5_minmax_near_dedup,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_wu_manber_decontaminate": op7_wu_manber_decontaminate,
    "op8_line_set_join": op8_line_set_join,
    "op9_ball_tree_top_k": op9_ball_tree_top_k,
    "op10_hilbert_packing": op10_hilbert_packing,
    "op11_collocations": op11_collocations,
    "op12_centroid_clusters": op12_centroid_clusters,
    "op13_url_rules": op13_url_rules,
}

__all__ = ["ORACLE", "QUERIES"]
