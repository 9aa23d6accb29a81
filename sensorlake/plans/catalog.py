"""Collects all registered queries."""

from sensorlake.plans import q_detections, q_exports, q_framesets, q_geometry, q_jobs, q_pixels, q_points, q_sources, q_streams, q_time  # noqa: F401
from sensorlake.plans.registry import COVERS, ORACLES, QUERIES

__all__ = ["COVERS", "ORACLES", "QUERIES"]
