"""Registered queries and their SQL."""

from . import oracle, queries, validation, validation_sql

REGISTRY = queries.REGISTRY
ORACLE = {**oracle.ORACLE, **validation_sql.ORACLE}

__all__ = ["ORACLE", "REGISTRY", "validation"]
