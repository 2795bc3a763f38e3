"""Column-expression builders (pure JVM expressions, no Python at run time)."""
