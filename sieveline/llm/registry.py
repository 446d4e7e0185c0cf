"""Queries of the text operators, and SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sieveline.llm.bpe import op7_bpe_encoding
from sieveline.llm.decontaminate import op4_benchmark_decontamination
from sieveline.llm.html import op10_html_extraction
from sieveline.llm.interaction import OP13_SQL, op13_filter_interaction
from sieveline.llm.linededup import OP5_SQL, op5_line_dedup
from sieveline.llm.maxent import op3_lm_scoring
from sieveline.llm.pii import op6_pii
from sieveline.llm.quality import OP1_SQL, op1_quality_rules
from sieveline.llm.secrets import op8_secret_scans
from sieveline.llm.simhash import op9_simhash_near_dedup
from sieveline.llm.tokencount import op12_token_counts
from sieveline.llm.toxicity import op2_toxicity
from sieveline.llm.variants import OP11_SQL, op11_spelling_variants


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality_rules, op2_toxicity, op3_lm_scoring, op4_benchmark_decontamination, op5_line_dedup, op6_pii, op7_bpe_encoding, op8_secret_scans, op9_simhash_near_dedup, op10_html_extraction, op11_spelling_variants, op12_token_counts, op13_filter_interaction)}


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": OP1_SQL, "op5_line_dedup": OP5_SQL, "op11_spelling_variants": OP11_SQL, "op13_filter_interaction": OP13_SQL}
