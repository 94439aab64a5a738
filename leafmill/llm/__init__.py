"""Operators for building training corpora (thirteen numbered operators and their queries)."""
