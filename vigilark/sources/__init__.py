"""Readers, writers, snapshots and HTTP sources."""
