"""Resumable collection of shards."""
