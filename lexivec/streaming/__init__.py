"""Operators over unbounded corpora."""
