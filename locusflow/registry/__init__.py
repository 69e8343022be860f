"""All registered queries and their SQL checks."""

from . import q_calls, q_catalog, q_ld, q_metrics, q_models, q_reduce, q_sources  # noqa: F401
from .base import CHECKS, QUERIES

__all__ = ["CHECKS", "QUERIES"]
