"""Queries and oracle SQL of the training-data operators, by name."""

from __future__ import annotations

from importlib import import_module

MODULES = ("bpe", "packing", "tokencount", "langid", "toxicity", "lm", "vectors", "ngram", "quotes", "fim", "importance", "exact")


def queries() -> dict:
    out = {}
    for m in MODULES:
        out |= import_module(f"{__package__}.{m}").QUERIES
    import corpus_pipeline

    return out | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for m in MODULES:
        out |= import_module(f"{__package__}.{m}").ORACLES
    import corpus_pipeline

    return out | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
