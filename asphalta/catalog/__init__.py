"""Registered queries, each with the SQL an independent engine can run."""

from .registry import ORACLE, QUERIES

from . import (aggregates, cleaning, functions, joins, modelling, sets, sources,  # noqa: F401,E402
               statistics, windows)

__all__ = ["ORACLE", "QUERIES"]
