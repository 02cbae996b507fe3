"""DataFrame operators. Column names and thresholds are parameters; ``as_of`` is an argument."""
