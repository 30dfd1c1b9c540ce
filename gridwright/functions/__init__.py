"""Column expressions and small distributed statistics used by the operators."""
