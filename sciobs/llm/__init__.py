"""Training-data operators: mixing, packing, deduplication, scoring, search."""
