"""Column expressions: error classification, text extraction, time buckets, numbers."""
