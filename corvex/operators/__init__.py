"""Relational, vector and semi-structured operators."""
