"""Training-data operators: filtering, deduplication, decontamination, token output and packing."""
