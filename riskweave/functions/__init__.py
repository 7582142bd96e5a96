"""Column -> Column expression library (JVM-side, codegen friendly)."""
