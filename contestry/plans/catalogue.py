"""All registered queries."""

from contestry.plans import queries_artefact, queries_models, queries_tables  # noqa: F401
from contestry.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
