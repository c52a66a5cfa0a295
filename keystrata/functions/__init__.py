"""Column expressions: codecs, checksums, sizes, Bloom arithmetic."""
