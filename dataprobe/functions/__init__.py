"""Column expressions: no joins, no shuffles, everything stays inside whole-stage code generation."""
