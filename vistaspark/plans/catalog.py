"""Imports every binding module so the registry is complete."""

from __future__ import annotations

from . import q_aggregates, q_filters, q_jobs, q_joins, q_ml, q_reports, q_rules, q_scalars, q_sources, q_streams, q_windows  # noqa: F401
from .registry import REGISTRY

__all__ = ["REGISTRY"]
