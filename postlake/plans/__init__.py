"""Whole jobs composed of the operators: silver, gold, publish, snapshot reports."""
