"""Structured Streaming front ends of the incremental operators."""
