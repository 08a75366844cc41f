"""Queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from plumbline.llm import divergence, fixity, hard_negatives, mixing, secrets, topk
from plumbline.llm.bpe import op2_bpe_chunk_reuse
from plumbline.llm.divergence import op11_cube_divergence
from plumbline.llm.fixity import op7_merkle_fixity
from plumbline.llm.hard_negatives import op12_lemp_hard_negatives
from plumbline.llm.kneser_ney import op10_kneser_ney
from plumbline.llm.mixing import op4_curriculum_mix
from plumbline.llm.quality import op5_decision_list
from plumbline.llm.repeats import op13_longest_previous_factors
from plumbline.llm.secrets import op9_blob_ledger
from plumbline.llm.sharding import op3_karmarkar_karp
from plumbline.llm.simhash import op1_simhash_gray
from plumbline.llm.tokencount import op6_viterbi_counts
from plumbline.llm.topk import op8_norm_sorted_topk

QUERIES = {
    f.__name__: f
    for f in (
        op1_simhash_gray,
        op2_bpe_chunk_reuse,
        op3_karmarkar_karp,
        op4_curriculum_mix,
        op5_decision_list,
        op6_viterbi_counts,
        op7_merkle_fixity,
        op8_norm_sorted_topk,
        op9_blob_ledger,
        op10_kneser_ney,
        op11_cube_divergence,
        op12_lemp_hard_negatives,
        op13_longest_previous_factors,
    )
}

#: The others hash, learn or search in ways SQL cannot express; tests hold them against brute force.
ORACLE: dict[str, str] = {
    "op4_curriculum_mix": mixing.ORACLE_SQL,
    "op7_merkle_fixity": fixity.ORACLE_SQL,
    "op8_norm_sorted_topk": topk.ORACLE_SQL,
    "op9_blob_ledger": secrets.ORACLE_SQL,
    "op11_cube_divergence": divergence.ORACLE_SQL,
    "op12_lemp_hard_negatives": hard_negatives.ORACLE_SQL,
}
