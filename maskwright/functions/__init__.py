"""Column functions: spans in text, text width, allow-list complements, splicing."""
