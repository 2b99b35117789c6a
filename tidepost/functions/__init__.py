"""Column expressions: text, URLs, times, hashes, similarity, redaction."""
