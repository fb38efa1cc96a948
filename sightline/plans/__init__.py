"""Named queries: how the operators apply to the given tables, with SQL for each."""
