"""Column expressions: JVM-side wherever Spark has the primitive."""
