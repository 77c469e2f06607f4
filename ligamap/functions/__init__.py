"""Column expressions: units, signals and colours."""
