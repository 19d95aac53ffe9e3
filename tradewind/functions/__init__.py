"""Column expressions: text clean-up, strict and lenient parsing, rounding, term matching."""
