"""Column builders: pure expressions over one row."""
