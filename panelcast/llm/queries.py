"""Registered queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (ann, lang_id, line_dedup, mixing, near_dedup, packing, quality, simhash, spelling, substring_dedup, toxicity,
               url_filter, whitening)
from .common import load


def _on(table: str, operator: Callable[[DataFrame], DataFrame]):
    return lambda spark, sf_dir: operator(load(spark, sf_dir, table))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ann": _on("embeddings", ann.op1_ann),
    "op2_mixing": _on("documents", mixing.op2_mixing),
    "op3_packing": _on("documents", packing.op3_packing),
    "op4_substring_dedup": _on("documents", substring_dedup.op4_substring_dedup),
    "op5_lang_id": _on("documents", lang_id.op5_lang_id),
    "op6_toxicity": lambda spark, sf_dir: toxicity.op6_toxicity(
        load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")),
    "op7_line_dedup": _on("documents", line_dedup.op7_line_dedup),
    "op8_url_filter": _on("pages", url_filter.op8_url_filter),
    "op9_near_dedup": _on("documents", near_dedup.op9_near_dedup),
    "op10_quality": _on("documents", quality.op10_quality),
    "op11_simhash": _on("documents", simhash.op11_simhash),
    "op12_spelling": _on("documents", spelling.op12_spelling),
    "op13_whitening": _on("embeddings", whitening.op13_whitening),
}

SQL: dict[str, str] = {
    "op1_ann": ann.SQL,
    "op2_mixing": mixing.SQL,
    "op7_line_dedup": line_dedup.SQL,
    "op12_spelling": spelling.SQL,
}
