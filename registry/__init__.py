"""The queries that are checked against SQL, and that SQL."""
