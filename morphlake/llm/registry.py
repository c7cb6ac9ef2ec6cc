"""Queries of the training-data operators and their SQL, where SQL can express them."""

from __future__ import annotations

import corpus_pipeline
from morphlake.llm import embeddings, fpindex, licenses, minhash, mixing, pieces, quality, repeats, secrets, warc

QUERIES = {
    "pipeline": corpus_pipeline.run,
    "op1_embedding_near_dedup": embeddings.op1_embedding_near_dedup,
    "op2_sentencepiece": pieces.op2_sentencepiece,
    "op3_warc_index": warc.op3_warc_index,
    "op4_secret_scan": secrets.op4_secret_scan,
    "op5_minhash_near_dedup": minhash.op5_minhash_near_dedup,
    "op6_maximal_repeats": repeats.op6_maximal_repeats,
    "op7_quality_rules": quality.op7_quality_rules,
    "op8_license_scan": licenses.op8_license_scan,
    "op9_mixing": mixing.op9_mixing,
    "op10_substring_dedup": fpindex.op10_substring_dedup,
    "quality_ablations": quality.quality_ablations,
}
ORACLES = {
    "op3_warc_index": warc.HISTORY_SQL,
    "op7_quality_rules": quality.LEDGER_SQL,
    "quality_ablations": quality.ABLATION_SQL,
}
