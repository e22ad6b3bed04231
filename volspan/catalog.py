"""All named queries and their oracles."""

from volspan.plans.oracles import ORACLES
from volspan.plans.queries import QUERIES

__all__ = ["ORACLES", "QUERIES"]
