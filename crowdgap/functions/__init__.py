"""Column expressions: measures, board strings, vectors."""
