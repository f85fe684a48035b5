"""Column builders: they take and return ``Column`` and never touch a DataFrame."""
