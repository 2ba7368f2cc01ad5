"""All named queries; importing the modules registers them."""

from meterstone.checks import anomalies, logs, metrics, quality, streams, tables, telemetry
from meterstone.checks.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "anomalies", "logs", "metrics", "quality", "streams", "tables", "telemetry"]
