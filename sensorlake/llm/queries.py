"""The registered queries of this package and their SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sensorlake.llm import op1_embeddings, op2_bpe, op3_substrings, op4_warc, op5_toxicity, op6_secrets, op7_simhash, op8_mixing, op9_topk, op10_quality, op11_resampling, op12_transducer, op13_divergence

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_embeddings": op1_embeddings.query,
    "op2_bpe": op2_bpe.query,
    "op3_substrings": op3_substrings.query,
    "op4_warc": op4_warc.query,
    "op5_toxicity": op5_toxicity.query,
    "op6_secrets": op6_secrets.query,
    "op7_simhash": op7_simhash.query,
    "op8_mixing": op8_mixing.query,
    "op9_topk": op9_topk.query,
    "op10_quality": op10_quality.query,
    "op11_resampling": op11_resampling.query,
    "op12_transducer": op12_transducer.query,
    "op13_divergence": op13_divergence.query,
}

ORACLES: dict[str, str] = {
    "op1_embeddings": op1_embeddings.SQL,
    "op3_substrings": op3_substrings.SQL,
    "op4_warc": op4_warc.SQL,
    "op8_mixing": op8_mixing.SQL,
    "op9_topk": op9_topk.SQL,
    "op11_resampling": op11_resampling.SQL,
    "op13_divergence": op13_divergence.SQL,
}
