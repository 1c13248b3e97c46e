"""Training-data operators: mixing, filtering, deduplication, search, sharding, media, archives, packing, toxicity."""
