"""Column expressions: text, labels, keyword rules, reply rules, sampling keys."""
