"""Schemas, readers, sinks and the adapters that shape the test tables like market data."""
