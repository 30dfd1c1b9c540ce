"""Work that spans several operators: the workspace, the report, the query list."""
