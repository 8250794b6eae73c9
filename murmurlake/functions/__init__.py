"""Column expressions: pure functions of columns, evaluated in the JVM."""
