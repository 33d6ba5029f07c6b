"""Column expressions: text, rules, record linkage, memory blocks."""
