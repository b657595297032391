"""The corpus: headers and observations, and adapters from plain tables."""
