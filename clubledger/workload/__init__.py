"""Club-shaped inputs derived from the benchmark tables, queries and their SQL."""
