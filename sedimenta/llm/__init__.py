"""Training-data operators: packing, similarity joins, search, scoring, formatting, dedup, tokenization and filters."""
