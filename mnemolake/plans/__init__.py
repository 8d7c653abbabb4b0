"""Queries put together from the operators, and the experiments."""

from __future__ import annotations


def all_queries() -> tuple[dict, dict]:
    """(plans by name, SQL by name) of all modules of this subpackage."""
    from . import benchmark, evaluation, history, policy, ranking, runner, texts, tuned  # noqa: F401
    from .registry import QUERIES, SQL

    return QUERIES, SQL
