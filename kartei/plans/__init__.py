"""Read-only catalogue queries: list, search, tag, stats and describe."""
