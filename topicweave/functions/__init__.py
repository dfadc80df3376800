"""Column expressions: per-row work that never leaves the JVM."""
