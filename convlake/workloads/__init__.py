"""All registered queries; importing a module registers its entries."""

from convlake.workloads import chunks, frames, graph, hooks, retrieval, streams, traces, turns  # noqa: F401
from convlake.workloads.registry import ORACLES, QUERIES, Tables

__all__ = ["ORACLES", "QUERIES", "Tables"]
