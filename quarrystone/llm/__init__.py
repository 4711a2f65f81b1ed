"""Training-data operators: formatting, filtering, deduplication, packing, search and media columns."""
