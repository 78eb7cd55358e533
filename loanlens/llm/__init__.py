"""Training-data operators: quality, deduplication, filtering, tokenising, search, mixing."""
