"""Structured Streaming variants of the detector and of calendar resampling."""
