"""Column expressions and tables that the graph operators share."""
