"""Composed jobs and the registered queries."""

from crowdgap.plans import queries_rows  # noqa: F401
from crowdgap.plans import queries_joins  # noqa: F401
from crowdgap.plans import queries_groups  # noqa: F401
from crowdgap.plans import queries_ranks  # noqa: F401
from crowdgap.plans import queries_vectors  # noqa: F401
from crowdgap.plans import queries_boards  # noqa: F401
from crowdgap.plans import queries_models  # noqa: F401
from crowdgap.plans import queries_io  # noqa: F401
from crowdgap.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
