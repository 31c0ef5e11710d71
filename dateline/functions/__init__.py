"""Column expressions. All are JVM-side: no Python runs per row."""
