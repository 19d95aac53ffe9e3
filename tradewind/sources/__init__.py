"""Reading raw CSV files; reading and writing tables; the test-data mapping."""
