"""The registered queries opN_<name> over whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, divergence, exact_dedup, fingerprints, language_id, mixing, ngram_join, periodic_runs, pii, suffix_dedup, suffix_tree, token_output, warc
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    docs = lambda spark, d: table(spark, d, "documents")
    return {
        "op1_pii": pii.op1_pii,
        "op2_suffix_tree": lambda s, d: suffix_tree.score_texts(docs(s, d)),
        "op3_exact_dedup": lambda s, d: exact_dedup.exact_dedup(docs(s, d)),
        "op4_mixing": lambda s, d: mixing.mix(docs(s, d)).drop("source"),
        "op5_warc": lambda s, d: warc.warc(table(s, d, "pages")),
        "op6_token_output": lambda s, d: token_output.token_output(docs(s, d)),
        "op7_ngram_join": lambda s, d: ngram_join.ngram_join(docs(s, d)),
        "op8_language_id": lambda s, d: language_id.language_id(docs(s, d)),
        "op9_suffix_dedup": lambda s, d: suffix_dedup.suffix_dedup(docs(s, d)),
        "op10_decontaminate": lambda s, d: decontaminate.decontaminate(docs(s, d), table(s, d, "benchmark"), shortest=decontaminate.SHORTEST),
        "op11_periodic_runs": lambda s, d: periodic_runs.op11_periodic_runs(docs(s, d)),
        "op12_divergence": lambda s, d: divergence.divergence(docs(s, d)),
        "op13_fingerprints": lambda s, d: fingerprints.op13_fingerprints(docs(s, d)),
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_exact_dedup": exact_dedup.ORACLE, "op4_mixing": mixing.ORACLE, "op5_warc": warc.ORACLE, "op7_ngram_join": ngram_join.ORACLE, "op12_divergence": divergence.ORACLE}
