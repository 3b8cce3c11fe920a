"""Column functions (JVM-side expressions) and their name-list twins."""
