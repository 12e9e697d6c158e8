"""Scans, sinks, table contracts, census payload parsers and test fixtures."""
