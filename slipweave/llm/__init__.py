"""Operators for preparing training corpora: dedup, mixing, language, quality, privacy, tokens."""
