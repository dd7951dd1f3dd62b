"""Imports every operator module of this subpackage, so that its queries and check SQL are registered."""

from __future__ import annotations

from wattline.llm import counting, decontamination, encoding, jaccard, language, negatives, prefix_forest, scoring, sharding, spelling, toxicity, vectors, warc  # noqa: F401
from wattline.llm.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
