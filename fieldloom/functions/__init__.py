"""Column-level building blocks: text, patterns, formats, display."""
