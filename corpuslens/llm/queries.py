"""Queries of the operators in this folder, and the SQL that some are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def register(build: Query) -> Query:
        QUERIES[name] = build
        if oracle is not None:
            ORACLES[name] = oracle
        return build

    return register


def queries() -> dict[str, Query]:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(ORACLES)


def _load() -> None:
    """Import every module that registers queries."""
    import corpus_pipeline
    from corpuslens.llm import (  # noqa: F401
        decontamination_queries,
        html_queries,
        importance_queries,
        language_queries,
        lexical_queries,
        mixing_queries,
        neardup_queries,
        piece_queries,
        quality_queries,
        secret_queries,
        tokenid_queries,
        toxicity_queries,
        url_queries,
    )

    QUERIES["pipeline"] = corpus_pipeline.run
    if corpus_pipeline.ORACLE_SQL is not None:
        ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
