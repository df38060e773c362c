"""Readers and writers of the corpus: shards, rank lists, URL text, state, models."""
