"""Training-data operators: mixing, packing, filtering, deduplication, search and counting."""
