"""The registered queries of the corpus operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import bpe, collocations, langid, lines, merkle, mixing, neardup, permutation, phrases, secrets, spans, toxicity, warc

QUERIES = {
    "op1_mix_sources": mixing.op1_mix_sources,
    "op2_near_dedup": neardup.op2_near_dedup,
    "op3_permutation_index": permutation.op3_permutation_index,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_line_dedup": lines.op5_line_dedup,
    "op6_warc": warc.op6_warc,
    "op7_decontaminate": phrases.op7_decontaminate,
    "op8_secret_scan": secrets.op8_secret_scan,
    "op9_suffix_dedup": spans.op9_suffix_dedup,
    "op10_language_id": langid.op10_language_id,
    "op11_byte_bpe": bpe.op11_byte_bpe,
    "op12_collocations": collocations.op12_collocations,
    "op13_merkle_manifest": merkle.op13_merkle_manifest,
}

SQL = {
    "op1_mix_sources": mixing.OP1_SQL,
    "op5_line_dedup": lines.OP5_SQL,
    "op6_warc": warc.OP6_SQL,
    "op7_decontaminate": phrases.OP7_SQL,
    "op12_collocations": collocations.OP12_SQL,
    "op13_merkle_manifest": merkle.OP13_SQL,
}
