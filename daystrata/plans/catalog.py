"""All registered queries, in inventory order."""

from daystrata.plans import q_labels, q_features, q_explore, q_metrics, q_quality, q_risk, q_models, q_sources  # noqa: F401, I001
from daystrata.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
