"""Readers and writers for landed market data."""
