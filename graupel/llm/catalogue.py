"""The registered queries of the text-corpus operators, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import alignment, bpe, chat, decontam, divergence, fingerprint, html, katz, langid, neardup, oracles, secrets, suffix, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_html_text": html.op1_html_text,
        "op2_language_id": langid.op2_language_id,
        "op3_decontamination": decontam.op3_decontamination,
        "op4_jaccard_join": neardup.op4_jaccard_join,
        "op5_chat_format": chat.op5_chat_format,
        "op6_weighted_fingerprint": fingerprint.op6_weighted_fingerprint,
        "op7_katz_score": katz.op7_katz_score,
        "op8_secret_scan": secrets.op8_secret_scan,
        "op9_byte_bpe": bpe.op9_byte_bpe,
        "op10_suffix_dedup": suffix.op10_suffix_dedup,
        "op11_toxicity": toxicity.op11_toxicity,
        "op12_source_divergence": divergence.op12_source_divergence,
        "op13_tokenizer_alignment": alignment.op13_tokenizer_alignment,
    }


def oracle_sql() -> dict[str, str]:
    return dict(oracles.ALL)
