"""Column functions: each takes and returns ``Column`` and stays inside the JVM where it can."""
