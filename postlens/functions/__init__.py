"""Column-expression builders (pure ``Column`` values, all JVM-side)."""
