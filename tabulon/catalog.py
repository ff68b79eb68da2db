"""Every registered query of the library and, where SQL can express it, its SQL."""

from __future__ import annotations

from .plans import corpora, encoding, evaluation, files, importing, learning, matching, relational, samples, searching, text  # noqa: F401
from .plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
