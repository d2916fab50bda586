"""The queries of this subpackage and, where DuckDB can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import bpe_codec, html_extract, media_audio, minhash_dedup, mixing, simhash, token_count, token_orc, toxicity, url_filter


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        media_audio.op1_audio_media,
        minhash_dedup.op2_minhash_dedup,
        bpe_codec.op3_bpe_codec,
        token_count.op4_token_counts,
        simhash.op5_simhash,
        html_extract.op6_main_text,
        toxicity.op7_toxicity,
        mixing.op8_source_mixing,
        token_orc.op9_token_files,
        url_filter.op10_url_rules,
    ]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op2_minhash_dedup": minhash_dedup.OP2_SQL, "op8_source_mixing": mixing.OP8_SQL, "op10_url_rules": url_filter.OP10_SQL}
