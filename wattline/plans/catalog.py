"""Imports every query module so that the registry is complete."""

from wattline.plans import q_clean, q_graph_joins, q_metrics, q_retrieval, q_select, q_sources, q_text, q_windows  # noqa: F401
from wattline.plans.registry import REGISTRY

__all__ = ["REGISTRY"]
