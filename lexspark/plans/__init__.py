"""Plans: operators put together, and the query catalogue."""
