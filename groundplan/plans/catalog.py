"""All registered queries; importing the modules registers them."""

from groundplan.plans import aggregates, endpoints, gold, io, relational, rest, scores, text  # noqa: F401
from groundplan.plans.registry import ORACLES, QUERIES

rest.name_views()

__all__ = ["ORACLES", "QUERIES"]
