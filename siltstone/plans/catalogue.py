"""All queries of the engine's own operators, with their SQL twins."""

from . import checks, corpus, logs, stored, tokens  # noqa: F401
from .base import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
