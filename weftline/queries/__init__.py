"""The driver's queries over its tables, and the SQL that each must equal."""

from . import annotations, concepts, manifest, masks, metrics, registry, remediate, sources, splits, stats, text
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "annotations", "concepts", "manifest", "masks", "metrics", "registry", "remediate", "sources", "splits", "stats", "text"]
