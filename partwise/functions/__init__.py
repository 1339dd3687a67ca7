"""Column-level helpers: guarded arithmetic, text folding, seeded draws."""
