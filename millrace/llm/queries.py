"""The queries of this package and their SQL, by name."""

from __future__ import annotations

from . import lines, maxscore, minhash, mixing, packing, phrases, pstable, quality, sharding, simhash, substrings, tokenfile, trie

QUERIES = {
    f.__name__: f
    for f in (
        tokenfile.op1_patched_frame_tokens,
        maxscore.op2_maxscore_top_k,
        substrings.op3_column_sorted_repeats,
        pstable.op4_multiprobe_neighbours,
        packing.op5_window_packing,
        quality.op6_kneser_ney_quality,
        lines.op7_segment_line_dedup,
        sharding.op8_label_propagation_shards,
        simhash.op9_simhash_components,
        mixing.op10_water_filling_mix,
        minhash.op11_one_permutation_minhash,
        trie.op12_truncation_peeling_trie,
        phrases.op13_marginal_collocations,
    )
}

#: SQL cannot express the tokenizer, hashes or searches of the others.
ORACLE_SQL: dict[str, str] = {
    "op2_maxscore_top_k": maxscore.OP2_SQL,
    "op12_truncation_peeling_trie": trie.OP12_SQL,
    "op13_marginal_collocations": phrases.OP13_SQL,
}
