"""Column expressions: text normalisation, markers, terms."""
