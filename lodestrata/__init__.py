"""Spark operators for splat clouds, their levels of detail, and job telemetry."""
