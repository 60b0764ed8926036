"""All registered queries (importing the modules fills the registry)."""

from scrubjay.suite import q_charts, q_flagship, q_profile, q_recipe, q_sources, q_steps  # noqa: F401
from scrubjay.suite.base import ORACLE, QUERIES

__all__ = ["QUERIES", "ORACLE"]
