"""Training-data operators: sharding, packing, scans, deduplication, scoring and token files."""
