"""The numbered queries over the synthetic tables, and their SQL where SQL can express them."""

from __future__ import annotations

from . import base_counts
from .best_fit_packing import op13_two_fit_packing
from .centroid_clustering import OP12_SQL, op12_annulus_clusters
from .decontamination import OP3_SQL, op3_ahocorasick_decontamination
from .filter_audit import OP11_SQL, op11_filter_audit
from .jaccard_join import OP4_SQL, op4_multiorder_jaccard
from .language_id import op1_centroid_language
from .line_dedup import OP5_SQL, op5_winnowing_lines
from .lm_scoring import op9_lattice_lm
from .packing import op6_bucket_packing
from .quality import op8_divergence_quality
from .resharding import op7_flow_resharding
from .substring_dedup import OP10_SQL, op10_recompression_dedup
from .toxicity import op2_segment_toxicity

QUERIES = {
    "op1_centroid_language": op1_centroid_language,
    "op2_segment_toxicity": op2_segment_toxicity,
    "op3_ahocorasick_decontamination": op3_ahocorasick_decontamination,
    "op4_multiorder_jaccard": op4_multiorder_jaccard,
    "op5_winnowing_lines": op5_winnowing_lines,
    "op6_bucket_packing": op6_bucket_packing,
    "op7_flow_resharding": op7_flow_resharding,
    "op8_divergence_quality": op8_divergence_quality,
    "op9_lattice_lm": op9_lattice_lm,
    "op10_recompression_dedup": op10_recompression_dedup,
    "op11_filter_audit": op11_filter_audit,
    "op12_annulus_clusters": op12_annulus_clusters,
    "op13_two_fit_packing": op13_two_fit_packing,
} | base_counts.QUERIES
ORACLE_SQL: dict[str, str] = {
    "op3_ahocorasick_decontamination": OP3_SQL,
    "op4_multiorder_jaccard": OP4_SQL,
    "op5_winnowing_lines": OP5_SQL,
    "op10_recompression_dedup": OP10_SQL,
    "op11_filter_audit": OP11_SQL,
    "op12_annulus_clusters": OP12_SQL,
} | base_counts.ORACLE_SQL
