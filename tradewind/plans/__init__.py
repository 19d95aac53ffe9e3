"""Jobs: cleaning, dimension keys, data models and the four analyses."""
