"""Operators for large training-data corpora. Nothing else in the library imports this subpackage."""

from __future__ import annotations


def load():
    """``(queries, oracles)`` of the subpackage's operators and of the corpus pipeline."""
    from quire.llm import queries

    return queries.QUERIES, queries.ORACLES
