"""Imports every query module, so that the registry is complete."""

from queries import files, findings, network, records, texts, tools, verdicts  # noqa: F401
from queries.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
