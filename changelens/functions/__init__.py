"""Column-level building blocks: patterns, paths, text and array helpers."""
