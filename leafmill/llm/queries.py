"""The queries of this subpackage, by name; each takes (spark, sf_dir)."""

from __future__ import annotations

from leafmill.llm import crossentropy, embeddings, fim, fingerprint, jaccard, licenses, mixing, packing, pieces, revisits, spelling, suffixes, toxicity

QUERIES = {
    "op1_packing": packing.op1_packing,
    "op2_revisits": revisits.op2_revisits,
    "op3_cross_entropy": crossentropy.op3_cross_entropy,
    "op4_jaccard": jaccard.op4_jaccard,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_mixing": mixing.op6_mixing,
    "op7_licenses": licenses.op7_licenses,
    "op8_embeddings": embeddings.op8_embeddings,
    "op9_suffixes": suffixes.op9_suffixes,
    "op10_fingerprints": fingerprint.op10_fingerprints,
    "op11_spelling": spelling.op11_spelling,
    "op12_pieces": pieces.op12_pieces,
    "op13_fill_in_middle": fim.op13_fill_in_middle,
}

ORACLES: dict[str, str] = {
    "op2_revisits": revisits.OP2_SQL,
    "op11_spelling": spelling.OP11_SQL,
    "op13_fill_in_middle": fim.OP13_SQL,
}
