"""Column-level building blocks. Every function returns a Spark Column or a
dict/tuple of Columns; nothing here runs Python per row."""
