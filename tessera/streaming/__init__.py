"""Scoring of live frames with Structured Streaming."""
