"""The queries of the corpus operators and their SQL."""

from __future__ import annotations

from vectide.llm import exact_dedup, langid, lattice, media, mixing, near_dedup, packing, pii, rollups, sharding

QUERIES = {
    "op1_extendible_shards": sharding.op1_extendible_shards,
    "op2_mpeg_media": media.op2_mpeg_media,
    "op3_mix_sources": mixing.op3_mix_sources,
    "op4_bottomk_near_dedup": near_dedup.op4_bottomk_near_dedup,
    "op5_surrogates": pii.op5_surrogates,
    "op6_language_id": langid.op6_language_id,
    "op7_pack_lengths": packing.op7_pack_lengths,
    "op8_radix_dedup": exact_dedup.op8_radix_dedup,
    "op9_token_rollups": rollups.op9_token_rollups,
    "op10_lattice_score": lattice.op10_lattice_score,
}

SQL = {
    "op1_extendible_shards": sharding.OP1_SQL,
    "op3_mix_sources": mixing.OP3_SQL,
    "op7_pack_lengths": packing.OP7_SQL,
    "op8_radix_dedup": exact_dedup.OP8_SQL,
    "op9_token_rollups": rollups.OP9_SQL,
}
