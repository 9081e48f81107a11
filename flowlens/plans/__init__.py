"""Registered queries: every operator on the given tables, with its SQL twin."""

from flowlens.plans.registry import ORACLES, QUERIES
from flowlens.plans import cleaning, evaluation, learning, operations, profiling, relations, streams  # noqa: F401
