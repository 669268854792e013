"""Operators that prepare training corpora, their queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import align, bpe, chat, embed, html_crf, iblt, langid, mixing, negatives, pii, quality, simhash, url_filter


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_pii": pii.query,
        "op2_urls": url_filter.query,
        "op3_simhash": simhash.query,
        "op4_sketch": iblt.query,
        "op5_embeddings": embed.query,
        "op6_quality": quality.query,
        "op7_bpe": bpe.query,
        "op8_mixing": mixing.query,
        "op9_html": html_crf.query,
        "op10_chat": chat.query,
        "op11_negatives": negatives.query,
        "op12_langid": langid.query,
        "op13_align": align.query,
        "chat_layouts": chat.layouts,
    }


def oracle_sql() -> dict[str, str]:
    """SQL of the operators whose results it can express; the others are tested against plain restatements."""
    return {"op5_embeddings": embed.SQL, "op9_html": html_crf.SQL, "op10_chat": chat.SQL, "op11_negatives": negatives.SQL, "chat_layouts": chat.LAYOUTS_SQL}
