"""Operators for large-scale training-data pipelines. Nothing else in the library imports this subpackage."""

from . import chat, decontam, divergence, hnsw, jaccard, langid, licenses, linededup, negatives, packing, quality, sharding, suffix
from .common import at_home

QUERIES = {
    "op1_ngram_jaccard": jaccard.query, "op2_chat_format": chat.query, "op3_pack": packing.query, "op4_shard_bytes": sharding.query,
    "op5_decontaminate": decontam.query, "op6_line_dedup": linededup.query, "op7_language_id": langid.query, "op8_hnsw": hnsw.query,
    "op9_suffix_dedup": suffix.query, "op10_quality": quality.query, "op11_source_divergence": divergence.query,
    "op12_license_scan": licenses.query, "op13_hard_negatives": negatives.query,
}
QUERIES = {name: at_home(f) for name, f in QUERIES.items()}
ORACLES = {
    "op1_ngram_jaccard": jaccard.ORACLE, "op2_chat_format": chat.ORACLE, "op4_shard_bytes": sharding.ORACLE, "op5_decontaminate": decontam.ORACLE,
    "op9_suffix_dedup": suffix.ORACLE, "op11_source_divergence": divergence.ORACLE, "op12_license_scan": licenses.ORACLE, "op13_hard_negatives": negatives.ORACLE,
}
