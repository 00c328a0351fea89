"""The queries of the corpus operators, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES = ("q01_decontamination", "q02_langid", "q03_licences", "q04_pii", "q05_html", "q06_sentence_spans", "q07_ivf_pq", "q08_sentencepiece", "q09_url_lists", "q10_fragment_join", "q11_mixing", "q12_anagrams", "q13_search")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in MODULES for k, f in import_module(f"noveltide.llm.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: f for m in MODULES for k, f in import_module(f"noveltide.llm.{m}").SQL.items()}
