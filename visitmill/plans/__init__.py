"""Time ranges, the test-data projection, and the registered queries with their SQL."""
