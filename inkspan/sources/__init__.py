"""Reading files and tables, staging intermediate tables, replacing result tables."""
