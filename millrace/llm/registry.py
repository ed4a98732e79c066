"""The queries of this package by name, and their DuckDB forms where SQL can express them."""

from __future__ import annotations

from functools import wraps

from ..session import ship
from . import bpe, digest, html, language, lm, mixing, pii, simhash, urls, vectors


def _shipped(query):
    @wraps(query)
    def run(spark, sf_dir):
        ship(spark)
        return query(spark, sf_dir)

    return run


QUERIES = {
    f.__name__: _shipped(f)
    for f in (
        mixing.op1_mixing,
        urls.op2_url_filter,
        html.op3_html_text,
        bpe.op4_byte_bpe,
        digest.op5_fingerprints,
        simhash.op6_simhash,
        language.op7_language,
        vectors.op8_embeddings,
        pii.op9_personal_data,
        lm.op10_lm_scores,
    )
}

ORACLES: dict[str, str] = {}
