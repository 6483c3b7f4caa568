"""One registered query per operator, each with SQL that gives the same rows."""

from . import q_books, q_jobs, q_ledger, q_money, q_tools  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
