"""Registered queries (``QUERIES``) and their DuckDB oracles (``ORACLE``)."""

from __future__ import annotations

from . import queries_kernels, queries_profile, queries_models, queries_outputs, queries_sampling, queries_stats  # noqa: F401  (registers)
from . import oracle_kernels, oracle_machines, oracle_outputs  # noqa: F401  (registers)
from .oracle import ORACLE
from .registry import QUERIES

__all__ = ["QUERIES", "ORACLE"]
