"""Structured Streaming twins of the telemetry rollups."""
