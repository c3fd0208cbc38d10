"""Column expressions: text, spans, times, labels and distances."""
