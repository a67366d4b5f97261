"""Column expressions: missing-value rules, labels, unit conversions and response rules."""
