"""Column functions: text, box algebra, rule scores, identifiers."""
