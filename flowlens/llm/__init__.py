"""Training-data operators: deduplication, decontamination, extraction, mixing, sharding, packing."""
