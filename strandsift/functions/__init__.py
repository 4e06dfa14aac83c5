"""Column functions: derived values, names and dates, sequences, alignment, clades."""
