"""Training-data operators: quality, deduplication, decontamination, mixing, tokens and binary output."""
