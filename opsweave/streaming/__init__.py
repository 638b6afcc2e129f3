"""Streaming forms of the operators: the same rules, incrementally."""
