"""Column expressions: R-compatible arithmetic, id checks, the Pearson test."""
