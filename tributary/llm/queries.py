"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from tributary.llm import audio, html, huffman, language, packing, pieces, quality, secrets, simhash, vectors

OPERATIONS = (
    simhash.op1_simhash, quality.op2_quality, packing.op3_packing, audio.op4_audio, huffman.op5_huffman, html.op6_html,
    pieces.op7_sentencepiece, vectors.op8_vectors, language.op9_language, secrets.op10_secrets,
)


def queries() -> dict:
    from corpus_pipeline import run

    return {f.__name__: f for f in OPERATIONS} | {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    """None: fingerprints, models, tokenizers, page parsing and code-point spans are beyond DuckDB's SQL; the tests hold them against brute force."""
    return {}
