"""Readers, writers and record projections of the sources."""
