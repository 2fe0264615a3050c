"""Reading files, tables and SQL text."""
