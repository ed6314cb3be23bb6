"""Training-data operators: deduplication, mixing, decontamination, formatting, language ID, sharding, WARC, URL filters."""
