"""DataFrame operators for record linkage."""

from lexmesh.operators.asof import as_of_join
from lexmesh.operators.blockgraph import block_graph
from lexmesh.operators.linkage import SEGMENTS, best_match, block_pairs, deletion_keys, fuzzy_anti, fuzzy_join, fuzzy_semi, metaphone_keys, soundex_keys
from lexmesh.operators.segments import near_values, nearest, values_of
from lexmesh.operators.sketches import estimates, merged, value_sketches

__all__ = ["SEGMENTS", "as_of_join", "best_match", "block_graph", "block_pairs", "deletion_keys", "estimates", "fuzzy_anti", "fuzzy_join", "fuzzy_semi", "merged", "metaphone_keys", "near_values", "nearest", "soundex_keys", "value_sketches", "values_of"]
