"""Named queries with their SQL equivalents."""

from __future__ import annotations

from . import calendar, chat, evidence, records, resolution, tables, texts  # noqa: F401  each registers its queries
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
