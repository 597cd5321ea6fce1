"""The queries of this subpackage, with their SQL where SQL can express them."""

from __future__ import annotations

import corpus_pipeline

from . import bpe, covertree, exact, htmltext, lines, minhash, packing, quality, sharding, toxicity


def queries() -> dict:
    return {
        "op1_quality": quality.op1_quality,
        "op2_line_dedup": lines.op2_line_dedup,
        "op3_toxicity": toxicity.op3_toxicity,
        "op4_sharding": sharding.op4_sharding,
        "op5_minhash": minhash.op5_minhash,
        "op6_bpe": bpe.op6_bpe,
        "op7_packing": packing.op7_packing,
        "op8_html": htmltext.op8_html,
        "op9_embeddings": covertree.op9_embeddings,
        "op10_exact_dedup": exact.op10_exact_dedup,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict:
    out = {"op2_line_dedup": lines.SQL, "op10_exact_dedup": exact.SQL}
    return out | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
