"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import alignment, collocations, exact_dedup, fingerprints, jaccard_join, language, mixing, packing, pieces, quality, sharding, substrings, toxicity

QUERIES = {
    "op1_sharding": sharding.op1_sharding,
    "op2_mixing": mixing.op2_mixing,
    "op3_language": language.op3_language,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_substrings": substrings.op5_substrings,
    "op6_jaccard_join": jaccard_join.op6_jaccard_join,
    "op7_exact_dedup": exact_dedup.op7_exact_dedup,
    "op8_fingerprints": fingerprints.op8_fingerprints,
    "op9_quality": quality.op9_quality,
    "op10_sentencepiece": pieces.op10_sentencepiece,
    "op11_packing": packing.op11_packing,
    "op12_collocations": collocations.op12_collocations,
    "op13_alignment": alignment.op13_alignment,
}

ORACLE_SQL = {
    "op2_mixing": mixing.OP2_SQL,
    "op6_jaccard_join": jaccard_join.OP6_SQL,
    "op7_exact_dedup": exact_dedup.OP7_SQL,
    "op12_collocations": collocations.OP12_SQL,
}
