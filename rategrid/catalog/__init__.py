"""Importing this package registers every query."""

from rategrid.catalog import matrices, ordered, schedules, stats, storage, timing  # noqa: F401
from rategrid.catalog.base import CATALOG

__all__ = ["CATALOG"]
