"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from .decontaminate import OP3_SQL, op3_decontaminate
from .embed_dedup import OP4_SQL, op4_int8_tiles
from .mixing import op5_mix_sources
from .neardup import OP8_SQL, op8_lsh_forest
from .quotes import OP1_SQL, op1_quotation_links
from .secret_scan import op9_secret_network
from .sharding import op10_lpt_shards
from .sst import op2_sorted_tables
from .toxicity import op6_subsequence_svm
from .wordpiece import op7_longest_match_counts

QUERIES = {
    "op1_quotation_links": op1_quotation_links,
    "op2_sorted_tables": op2_sorted_tables,
    "op3_decontaminate": op3_decontaminate,
    "op4_int8_tiles": op4_int8_tiles,
    "op5_mix_sources": op5_mix_sources,
    "op6_subsequence_svm": op6_subsequence_svm,
    "op7_longest_match_counts": op7_longest_match_counts,
    "op8_lsh_forest": op8_lsh_forest,
    "op9_secret_network": op9_secret_network,
    "op10_lpt_shards": op10_lpt_shards,
}

ORACLES = {
    "op1_quotation_links": OP1_SQL,
    "op3_decontaminate": OP3_SQL,
    "op4_int8_tiles": OP4_SQL,
    "op8_lsh_forest": OP8_SQL,
}
