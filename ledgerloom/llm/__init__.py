"""Training-data operators: deduplication, filters, search, tokens and packing."""
