"""The queries over the test tables, each with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from . import curation, datasets, evaluation, extensions, forms, incremental, items
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "curation", "datasets", "evaluation", "extensions", "forms", "incremental", "items"]
