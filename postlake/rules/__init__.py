"""Controlled vocabularies, word lists, patterns and thresholds, as data."""
