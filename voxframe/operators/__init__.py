"""Relational, interval, vector and identity operators."""
