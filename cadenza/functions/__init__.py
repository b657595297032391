"""Scalar functions over columns, and the canonical identity of documents."""
