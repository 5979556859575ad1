"""The registered queries of the text operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from milemark.llm import alignment, chat, embeddings, fingerprints, langid, lines, mixing, packing, quality, repair, simhash, toxicity, urls


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_embeddings": embeddings.op1,
        "op2_mixing": mixing.op2,
        "op3_lines": lines.op3,
        "op4_chat": chat.op4,
        "op5_langid": langid.op5,
        "op6_simhash": simhash.op6,
        "op7_quality": quality.op7,
        "op8_toxicity": toxicity.op8,
        "op9_urls": urls.op9,
        "op10_packing": packing.op10,
        "op11_fingerprints": fingerprints.op11,
        "op12_alignment": alignment.op12,
        "op13_repair": repair.op13,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_embeddings": embeddings.OP1_SQL,
        "op2_mixing": mixing.OP2_SQL,
        "op9_urls": urls.sql(),
        "op11_fingerprints": fingerprints.OP11_SQL,
    }
