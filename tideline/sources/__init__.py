"""Readers and the adapters that bring tables into the trade schema."""
