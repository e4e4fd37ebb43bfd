"""Column expressions: intervals, times, vectors, labels."""
