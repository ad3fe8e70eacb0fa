"""Training-data operators: deduplication, scoring, extraction, tokenising and media."""
