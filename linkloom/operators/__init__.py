"""Relational operators: corpus selection, statistics, n-grams, vocabularies and context models."""
