"""All registered queries; importing the topic modules registers them."""

from millrace.plans import display, merging, parsing, serving, streams  # noqa: F401
from millrace.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
