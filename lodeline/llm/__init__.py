"""Training-data operators: packing, rollups, WARC, LM scoring, toxicity, deduplication and tokenization."""
