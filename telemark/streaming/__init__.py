"""Structured Streaming forms of the bucketed telemetry queries."""
