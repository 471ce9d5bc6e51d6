"""Column expressions: text, numbers, bands and alert wording."""
